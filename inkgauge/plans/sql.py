"""The same results in DuckDB's SQL, written relationally: tokens and sentences are rows here, not arrays."""

from __future__ import annotations

from .. import lexicon as L
from ..functions import text as T
from ..operators import detectors as D
from ..operators import markdown as MD
from ..operators import provenance as P
from ..operators.perturb import phrase_pattern
from .made_files import COMMENT_BYTES, OPENING

STOCK = "In today's world, it is important to note that we leverage a wide range of robust tools. In conclusion, this article will delve into the landscape."
Q = lambda s: s.replace("'", "''")
SP = T.SPACE
INJECTED = f"CASE WHEN doc_id % 5 = 0 THEN '{Q(STOCK)}' || ' ' || text ELSE text END"
DOCS = f"SELECT doc_id, {INJECTED} AS text FROM documents"
#: What the made image and PDF files carry.
PACKETS = f"SELECT doc_id, '{OPENING}' || coalesce(text, '') AS x FROM documents"
WORD = r"regexp_matches(x, '^\p{L}')"
TOK = Q(T.TOKEN)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def lower_words(x: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({x}, '{TOK}'), lambda x: {WORD}), lambda x: lower(x))"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def inv(x: str, m: float, k: float) -> str:
    return f"(1.0 - 1.0 / (1.0 + exp(-{k}::DOUBLE * ({x} - {m}::DOUBLE))))"


def log(x: str, m: float, k: float) -> str:
    return f"(1.0 / (1.0 + exp(-{k}::DOUBLE * ({x} - {m}::DOUBLE))))"


def band(x: str, lo: float, hi: float) -> str:
    w = hi - lo
    return f"(CASE WHEN {x} BETWEEN {lo} AND {hi} THEN 1.0 WHEN {x} < {lo} THEN {clamp(f'1 - ({lo} - {x}) / {w}')} ELSE {clamp(f'1 - ({x} - {hi}) / {w}')} END)"


def words_in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{Q(w)}'" for w in words) + ")"


def syllables(w: str) -> str:
    letters = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    return f"CASE WHEN {letters} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace({letters}, 'e$', ''), '[aeiouy]+'))) END"


def green(seed: int | str, prev: str = "prev", tok: str = "tok") -> str:
    return f"(CASE WHEN ('0x' || substr(md5(concat_ws(chr(31), '{seed}', {prev}, {tok}, 'g')), 1, 7))::BIGINT % 10000 < 5000 THEN 1 ELSE 0 END)"


def base(docs: str = DOCS) -> str:
    """b: a row for each document; t: its lower-cased words; se: its sentences; n: its number of words."""
    marked = f"regexp_replace(raw, '([.!?])[{SP}]+([\"''(A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"""WITH docs AS ({docs}),
b0 AS (SELECT doc_id, {strip("coalesce(text, '')")} AS raw FROM docs),
b1 AS (SELECT doc_id, raw, regexp_extract_all(raw, '{TOK}') AS toks,
  list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS sents FROM b0),
b AS MATERIALIZED (SELECT doc_id, raw, toks, sents, list_filter(toks, lambda x: {WORD}) AS words FROM b1),
n AS (SELECT doc_id, len(words)::BIGINT AS n, len(sents)::BIGINT AS k FROM b),
t AS MATERIALIZED (SELECT doc_id, pos, lower(w) AS tok, w FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM b)),
se AS MATERIALIZED (SELECT doc_id, i, s, {lower_words('s')} AS sw FROM (SELECT doc_id, unnest(sents) AS s, generate_subscripts(sents, 1) AS i FROM b)),
c AS (SELECT doc_id, tok, count(*) AS c FROM t GROUP BY ALL),
rich0 AS (SELECT doc_id, count(*) AS v, count(*) FILTER (c = 1) AS v1, sum(c * c)::BIGINT AS sq FROM c GROUP BY 1),
rich AS (SELECT n.doc_id, n, k, coalesce(v / n::DOUBLE, 0) AS ttr, coalesce(v1 / n::DOUBLE, 0) AS hapax,
  CASE WHEN n < 8 THEN 0 ELSE 10000.0 * (sq - n) / (n::DOUBLE * n) END AS yules_k,
  CASE WHEN n < 8 OR v = v1 THEN 0 ELSE 100 * ln(n::DOUBLE) / (1 - v1 / v::DOUBLE) END AS honores_r FROM n LEFT JOIN rich0 USING (doc_id)),
sl0 AS (SELECT doc_id, len(sw)::DOUBLE AS x FROM se UNION ALL SELECT doc_id, n FROM n WHERE k = 0),
sl1 AS (SELECT doc_id, count(*) AS k, avg(x) AS mean_sl, coalesce(stddev_samp(x), 0) AS std_sl FROM sl0 GROUP BY 1),
sl AS (SELECT *, CASE WHEN k < 2 OR mean_sl <= 0 THEN 0 ELSE std_sl / mean_sl END AS burstiness,
  CASE WHEN k < 3 OR mean_sl <= 0 THEN 0 ELSE {inv('std_sl / mean_sl', 0.38, 8)} END AS length_uniformity FROM sl1),
flesch AS (SELECT n.doc_id, CASE WHEN n > 0 AND k > 0 THEN 206.835 - 1.015 * n / k - 84.6 * syl / n ELSE 0 END AS flesch, coalesce(syl, 0) AS syl
  FROM n LEFT JOIN (SELECT doc_id, sum({syllables('w')})::BIGINT AS syl FROM t GROUP BY 1) USING (doc_id))"""


RANKS = f"ranks AS (SELECT tok AS word, row_number() OVER (ORDER BY c DESC, tok) AS rank FROM (SELECT tok, count(*) AS c FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {L.RANKED_WORDS}))"
#: The ranks of the words of documents, whatever docs is.
CORPUS_RANKS = f"""ranks AS (SELECT tok AS word, row_number() OVER (ORDER BY c DESC, tok) AS rank FROM (SELECT tok, count(*) AS c FROM (
  SELECT unnest({lower_words(strip(f'({INJECTED})'))}) AS tok FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {L.RANKED_WORDS}))"""
NEXT = "p AS MATERIALIZED (SELECT doc_id, pos, lag(tok) OVER w AS prev, tok, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS nxt2 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
PERPLEXITY = """ppl AS (SELECT n.doc_id, CASE WHEN n = 0 THEN 0 ELSE least(exp(least(m, 20)), 1e6) END AS perplexity FROM n LEFT JOIN (
  SELECT doc_id, avg(CASE WHEN rank IS NULL THEN ln(50000 * ln(50000)) ELSE ln((rank + 2) * ln(50001)) END) AS m
  FROM t LEFT JOIN ranks ON tok = word GROUP BY 1) USING (doc_id))"""
_bound = r"(?:^|[^\p{L}\p{N}_])(?:%s)(?:$|[^\p{L}\p{N}_])"
_hits = " + ".join(
    [
        # A space between neighbouring matches' ends keeps them apart without lookaround.
        f"len(regexp_extract_all(regexp_replace(lower(raw), '([^\\p{{L}}\\p{{N}}_''-])', '\\1\\1', 'g'), '{Q(_bound % x)}'))"
        for x in (L.HEDGES.replace(" ", "  "), L.STOCK_WORDS.replace("[- ]", "(?:-|  )"))
    ]
    + [f"(CASE WHEN contains(lower(raw), '{Q(x)}') THEN 1 ELSE 0 END)" for x in L.STOCK_PHRASES]
)
PHRASES = f"ph AS (SELECT doc_id, {clamp(f'({_hits}) / greatest(1.0, greatest(1, len(words)) / 80.0) / 3.0 * 1.4')} AS phrase_density FROM b)"
_head = " OR ".join(f"starts_with(h, '{Q(o)}') OR contains(substr(h, 1, 40), '{Q(o)}')" for o in L.OPENERS)
OPENERS = f"""op AS (SELECT n.doc_id, CASE WHEN k = 0 THEN 0 ELSE {clamp('hits / greatest(2.0, (least(k, 8) + least(k, 3)) / 3.0)')} END AS opener_score
  FROM n LEFT JOIN (SELECT doc_id, sum(CASE WHEN {_head} THEN (i <= 8)::INT + (i > k - 3)::INT ELSE 0 END) AS hits
    FROM (SELECT doc_id, i, k, substr(lower(s), 1, 48) AS h FROM se JOIN n USING (doc_id)) GROUP BY 1) USING (doc_id))"""
REUSE = f"""re AS (SELECT n.doc_id, CASE WHEN n - 2 < 12 THEN 0 ELSE {clamp('(n - 2 - d) / (n - 2)::DOUBLE * 4')} END AS ngram_reuse
  FROM n LEFT JOIN (SELECT doc_id, count(*) AS d FROM (SELECT DISTINCT doc_id, tok, nxt, nxt2 FROM p WHERE nxt2 IS NOT NULL) GROUP BY 1) USING (doc_id))"""
PUNCT = f"""pu AS (SELECT b.doc_id, CASE WHEN coalesce(m, 0) < 8 THEN 0.3 ELSE {inv('e / ln(greatest(2, v)::DOUBLE)', 0.55, 5)} END AS punctuation_uniformity FROM b LEFT JOIN (
  SELECT doc_id, sum(c) AS m, count(*) AS v, -sum(c / s * ln(c / s + 1e-12)) AS e FROM (
    SELECT doc_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS s FROM (
      SELECT doc_id, unnest(regexp_extract_all(raw, '[,.;:!?—\\-]')) AS ch FROM b) GROUP BY doc_id, ch) GROUP BY 1) USING (doc_id))"""
FUNCTION = f"""fw AS (SELECT n.doc_id, coalesce(f / n::DOUBLE, 0) AS function_word_ratio FROM n LEFT JOIN (
  SELECT doc_id, count(*) AS f FROM t WHERE tok IN {words_in(L.FUNCTION_WORDS)} GROUP BY 1) USING (doc_id))"""
_expected = ", ".join(f"('{w}', {s})" for w, s in L.EXPECTED_SHARE.items())
FIT = f"""e AS (SELECT n.doc_id, n, word, share FROM n, (VALUES {_expected}) e(word, share)),
r AS (SELECT n.doc_id, word FROM n, (VALUES {', '.join(f"('{w}')" for w in L.RARE_FUNCTION_WORDS)}) r(word)),
fit AS (SELECT n.doc_id, CASE WHEN n = 0 THEN 0 ELSE {clamp('0.75 * close + 0.25 * missing')} END AS function_word_fit FROM n
  JOIN (SELECT e.doc_id, avg(1 - least(1.0, abs(coalesce(c.c, 0) / nullif(n, 0)::DOUBLE - share) / (share + 1e-6))) AS close FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.tok = e.word GROUP BY 1) USING (doc_id)
  JOIN (SELECT r.doc_id, avg((c.c IS NULL)::INT) AS missing FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.tok = r.word GROUP BY 1) USING (doc_id))"""
STARTS = """sd AS (SELECT n.doc_id, coalesce(d, 0) AS start_diversity FROM n LEFT JOIN (
  SELECT doc_id, count(DISTINCT sw[1]) / count(*)::DOUBLE AS d FROM se WHERE len(sw) > 0 GROUP BY 1) USING (doc_id))"""
ADJACENT = """adj AS (SELECT n.doc_id, coalesce(a, 0) AS adjacent_similarity FROM n LEFT JOIN (
  SELECT doc_id, avg(CASE WHEN len(sw) = 0 OR len(bef) = 0 THEN 0 ELSE len(list_intersect(list_distinct(sw), list_distinct(bef))) / len(list_distinct(list_concat(sw, bef)))::DOUBLE END) AS a
  FROM (SELECT doc_id, sw, lag(sw) OVER (PARTITION BY doc_id ORDER BY i) AS bef FROM se) WHERE bef IS NOT NULL GROUP BY 1) USING (doc_id))"""
BIGRAMS = """bi AS (SELECT n.doc_id, coalesce(e, 0) AS bigram_entropy FROM n LEFT JOIN (
  SELECT doc_id, -sum(c / s * ln(c / s + 1e-12)) AS e FROM (
    SELECT doc_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS s FROM p WHERE nxt IS NOT NULL GROUP BY doc_id, tok, nxt) GROUP BY 1) USING (doc_id))"""
STYLE = r"""st AS (SELECT doc_id, len(list_filter(toks, lambda x: x = ',')) / greatest(1, len(words))::DOUBLE AS comma_ratio,
  len(list_filter(words, lambda x: contains(x, ''''))) / greatest(1, len(words))::DOUBLE AS contraction_ratio,
  len(list_filter(toks, lambda x: regexp_matches(x, '^\p{Nd}'))) / greatest(1, len(toks))::DOUBLE AS digit_ratio,
  (len(regexp_extract_all(raw, '"')) + len(regexp_extract_all(raw, '“')) + len(regexp_extract_all(raw, '’s')))::BIGINT AS quote_count,
  syl / greatest(1, len(words))::DOUBLE AS avg_syllables, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / greatest(1, len(words))::DOUBLE AS mean_wl
  FROM b JOIN flesch USING (doc_id))"""
CLASSICAL = f"""cl AS (SELECT n.doc_id, n, perplexity, burstiness, ttr, hapax, phrase_density, opener_score, length_uniformity, ngram_reuse, punctuation_uniformity, function_word_ratio,
  0.14 * {inv('perplexity', 80, 0.04)} + 0.12 * {inv('burstiness', 0.55, 5)} + 0.08 * {inv('ttr', 0.52, 8)} + 0.04 * {inv('hapax', 0.45, 6)} + 0.30 * phrase_density
  + 0.12 * opener_score + 0.08 * length_uniformity + 0.06 * ngram_reuse + 0.04 * punctuation_uniformity + 0.02 * {log('function_word_ratio', 0.45, 10)} AS mix
  FROM n JOIN ppl USING (doc_id) JOIN sl USING (doc_id) JOIN rich USING (doc_id, n) JOIN ph USING (doc_id) JOIN op USING (doc_id) JOIN re USING (doc_id) JOIN pu USING (doc_id) JOIN fw USING (doc_id)),
classical AS (SELECT *, CASE WHEN n < 12 THEN 0 ELSE {clamp('CASE WHEN phrase_density >= 0.55 THEN greatest(mix, 0.52 + 0.40 * phrase_density) ELSE mix END')} END AS classical_score,
  CASE WHEN n < 12 THEN 0 ELSE {clamp('0.35 + 0.45 * log10(greatest(n, 10)::DOUBLE) / 3.0')} * CASE WHEN n < 80 THEN 0.7 ELSE 1 END END AS classical_confidence FROM cl)"""
CLASSICAL_PARTS = [RANKS, NEXT, PERPLEXITY, PHRASES, OPENERS, REUSE, PUNCT, FUNCTION, CLASSICAL]
STYLOMETRIC = f"""sty AS (SELECT n.doc_id, n,
  0.10 * {inv('ttr', 0.55, 8)} + 0.08 * {log('yules_k', 120, 0.03)} + 0.05 * {inv('honores_r', 800, 0.004)} + 0.08 * {band('mean_sl', 16.0, 24.0)} + 0.10 * {inv('std_sl', 6.5, 0.25)}
  + 0.10 * {log('function_word_fit', 0.55, 6)} + 0.10 * {inv('contraction_ratio', 0.025, 40)} + 0.10 * {inv('start_diversity', 0.62, 6)} + 0.10 * {log('adjacent_similarity', 0.28, 8)}
  + 0.07 * {inv('bigram_entropy', 4.2, 1.2)} + 0.04 * {band('comma_ratio', 0.04, 0.09)} + 0.04 * {band('avg_syllables', 1.45, 1.75)} + 0.04 * {inv('hapax', 0.48, 6)} AS mix
  FROM n JOIN rich USING (doc_id, n) JOIN sl USING (doc_id) JOIN fit USING (doc_id) JOIN st USING (doc_id) JOIN sd USING (doc_id) JOIN adj USING (doc_id) JOIN bi USING (doc_id)),
stylometric AS (SELECT doc_id, n, CASE WHEN n < 12 THEN 0 ELSE {clamp('mix')} END AS stylometric_score,
  CASE WHEN n < 12 THEN 0 ELSE {clamp('0.40 + 0.40 * log10(greatest(n, 10)::DOUBLE) / 3.0')} END AS stylometric_confidence FROM sty)"""
STYLOMETRIC_PARTS = [NEXT, FIT, STARTS, ADJACENT, BIGRAMS, STYLE, STYLOMETRIC]
SCAN = f"""zs AS (SELECT doc_id, seed, i, k, hits, 2 * hits - k AS t FROM (
  SELECT n.doc_id, n.seed, i, coalesce(hits, 0)::BIGINT AS hits, greatest(1, n - 1)::BIGINT AS k FROM (
    SELECT n.doc_id, n, seed, i FROM n, (VALUES {', '.join(f'({s}, {i})' for i, s in enumerate(L.GREEN_SEEDS))}) s(seed, i)) n LEFT JOIN (
    {' UNION ALL '.join(f'SELECT doc_id, {s} AS seed, sum({green(s)}) AS hits FROM p WHERE prev IS NOT NULL GROUP BY 1' for s in L.GREEN_SEEDS)}) h ON h.doc_id = n.doc_id AND h.seed = n.seed)),
scan AS (SELECT doc_id, max(t)::DOUBLE / sqrt(any_value(k)::DOUBLE) AS max_z, sum(abs(t))::DOUBLE / (12 * sqrt(any_value(k)::DOUBLE)) AS mean_abs_z,
  sqrt((12 * sum(t * t) - sum(t) * sum(t))::DOUBLE / (132 * any_value(k))::DOUBLE) AS z_std, sum(hits)::DOUBLE / (12 * any_value(k)) AS mean_rate,
  max(hits)::DOUBLE / any_value(k) AS max_rate, arg_max(seed, hits * 100 - i) AS best_seed FROM zs GROUP BY 1)"""
CONSISTENCY = f"""cc AS (SELECT n.doc_id, CASE WHEN n < 24 THEN 0 WHEN coalesce(k2, 0) < 4 THEN 0.15 ELSE {clamp('(m - 0.35) / 0.5')} END AS context_consistency FROM n LEFT JOIN (
  SELECT doc_id, count(*) AS k2, avg(top / s::DOUBLE) AS m FROM (
    SELECT doc_id, max(c) AS top, sum(c) AS s FROM (SELECT doc_id, tok, nxt, nxt2, count(*) AS c FROM p WHERE nxt2 IS NOT NULL GROUP BY ALL) GROUP BY doc_id, tok, nxt)
  WHERE s >= 2 GROUP BY 1) USING (doc_id))"""


def windows(name: str, size: int, stride: int, seed: int) -> str:
    """name: doc_id, start, m, hits of the windows over a document's words."""
    last = f"greatest(0, ceil((n - {size}) / {stride}::DOUBLE))::BIGINT"
    return f"""{name}0 AS (SELECT doc_id, n, win * {stride} AS start FROM (SELECT doc_id, n, unnest(range(0, {last} + 1)) AS win FROM n)),
{name}g AS MATERIALIZED (SELECT doc_id, pos, {green(seed)} AS g FROM p WHERE prev IS NOT NULL),
{name} AS (SELECT {name}0.doc_id, start, least({size}, n - start) AS m, coalesce(sum(g), 0) AS hits FROM {name}0
  LEFT JOIN {name}g ON {name}g.doc_id = {name}0.doc_id AND pos > start + 1 AND pos <= start + {size} GROUP BY ALL)"""


SPIKE = f"""{windows('w48', 48, 24, L.GREEN_SEEDS[0])},
rates AS (SELECT doc_id, hits / greatest(1, m - 1)::DOUBLE AS r FROM w48 JOIN n USING (doc_id) WHERE m >= 8 AND n >= 48),
sp0 AS (SELECT doc_id, count(*) AS k, avg(r) AS m, stddev_samp(r) AS s FROM rates GROUP BY 1),
sp AS (SELECT n.doc_id, coalesce(x, 0) AS window_spike FROM n LEFT JOIN (
  SELECT doc_id, CASE WHEN any_value(k) < 2 OR any_value(s) <= 1e-9 THEN 0 ELSE {clamp('(max(abs(r - m)) / any_value(s) - 1.1) / 3.0')} END AS x FROM rates JOIN sp0 USING (doc_id) GROUP BY 1) USING (doc_id))"""
RARE = f"""rg AS (SELECT doc_id, {green(L.GREEN_SEEDS[1])} AS g, coalesce(rank > {L.COMMON_RANK}, true) AS rare FROM p LEFT JOIN ranks ON tok = word WHERE prev IS NOT NULL),
ra AS (SELECT n.doc_id, CASE WHEN n < 24 OR coalesce(rn, 0) < 6 OR coalesce(cn, 0) < 6 THEN 0 ELSE {clamp('(rh / rn::DOUBLE - ch / cn::DOUBLE) / 0.25')} END AS rare_alignment FROM n LEFT JOIN (
  SELECT doc_id, count(*) FILTER (rare) AS rn, sum(g) FILTER (rare) AS rh, count(*) FILTER (NOT rare) AS cn, sum(g) FILTER (NOT rare) AS ch FROM rg GROUP BY 1) USING (doc_id))"""
HOT = f"""{windows('w80', 80, 40, L.GREEN_SEEDS[0])},
hot AS (SELECT doc_id, start, start + m AS stop, (hits / (m - 1)::DOUBLE - 0.5) / sqrt(0.25 / (m - 1)) AS z FROM w80 JOIN n USING (doc_id) WHERE n >= 80)"""
STATISTICAL = f"""stat AS (SELECT n.doc_id, n, max_z, mean_abs_z, z_std, context_consistency, window_spike, rare_alignment,
  CASE WHEN n < 16 THEN 0 ELSE {clamp('0.34 * ' + clamp('(max_z - 1.2) / 4.0') + ' + 0.12 * ' + clamp('mean_abs_z / 2.5') + ' + 0.10 * ' + clamp('(z_std - 0.4) / 1.6') + ' + 0.22 * context_consistency + 0.14 * window_spike + 0.08 * rare_alignment')} END AS statistical_score,
  CASE WHEN n < 16 THEN 0 ELSE {clamp('0.22 + 0.35 * log10(greatest(n, 16)::DOUBLE) / 3.0')} END AS statistical_confidence
  FROM n JOIN scan USING (doc_id) JOIN cc USING (doc_id) JOIN sp USING (doc_id) JOIN ra USING (doc_id))"""
STATISTICAL_PARTS = [RANKS, NEXT, SCAN, CONSISTENCY, SPIKE, RARE, STATISTICAL]
_names = ("classical", "stylometric", "statistical")
_w = {"classical": 0.34, "stylometric": 0.28, "statistical": 0.30}
ENSEMBLE = f"""m AS (SELECT doc_id, classical_score AS s1, classical_confidence AS c1, stylometric_score AS s2, stylometric_confidence AS c2, statistical_score AS s3, statistical_confidence AS c3
  FROM classical JOIN stylometric USING (doc_id) JOIN stat USING (doc_id)),
v AS (SELECT doc_id, s, c, w * greatest(0.15, c) AS w, s > 0 OR c > 0 AS votes, f FROM (
  {' UNION ALL '.join(f"SELECT doc_id, s{i} AS s, c{i} AS c, {_w[x]} AS w, {i} AS f FROM m" for i, x in enumerate(_names, 1))})),
u AS (SELECT * FROM (SELECT *, bool_or(votes) OVER (PARTITION BY doc_id) AS voted FROM v) WHERE votes OR NOT voted),
en0 AS (SELECT doc_id, sum(s * w) / sum(w) AS ensemble_score, greatest(0.0, 1 - coalesce(stddev_samp(s), 0) / 0.35) AS agreement, sum(c * w) / sum(w) AS wc FROM u GROUP BY 1),
en AS (SELECT doc_id, ensemble_score, agreement, {clamp('0.7 * wc + 0.3 * agreement')} AS ensemble_confidence,
  CASE WHEN round(s3, 4) >= 0.70 AND round(s3, 4) >= ensemble_score THEN 'watermark' ELSE 'ensemble' END AS family FROM en0 JOIN m USING (doc_id)),
lab AS (SELECT *, CASE WHEN family = 'watermark' AND ensemble_score >= 0.70 THEN 'watermarked' WHEN family <> 'watermark' AND ensemble_score >= 0.62 THEN 'ai' WHEN ensemble_score >= 0.45 THEN 'uncertain' ELSE 'human' END AS label FROM en)"""
ENSEMBLE_PARTS = list(dict.fromkeys([*CLASSICAL_PARTS, *STYLOMETRIC_PARTS, *STATISTICAL_PARTS, ENSEMBLE]))


def query(parts: list[str], select: str, docs: str = DOCS) -> str:
    return ",\n".join([base(docs), *parts]) + "\n" + select


R = lambda *xs: ", ".join(f"round({x}::DOUBLE, 6) AS {x}" for x in xs)

#: Markdown around every seventh document, and marks in every fourth page.
MARKDOWN = f"CASE WHEN doc_id % 7 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# Head' || chr(10) || text || chr(10) || '- item one' || chr(10) || '> said' || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '<div>' || chr(10) ELSE text END"
MARKS = '<head><meta name="generator" content="x"><meta property="c2pa.claim" content="y"><link rel="provenance" href="z"><script type="application/ld+json">{"a": "C2PA"}</script>'
_bare = r"regexp_replace(t, '[\r\n]+$', '')"
SEGMENTS = f"""WITH md AS (SELECT doc_id, {MARKDOWN} AS text FROM documents),
l0 AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ls FROM md),
l1 AS (SELECT doc_id, line, t, {_bare} AS bare, regexp_matches({_bare}, '^---\\s*$') AS rule FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line FROM l0)),
l2 AS (SELECT *, max(CASE WHEN line = 0 AND rule THEN 1 ELSE 0 END) OVER w = 1 AND coalesce(sum(CASE WHEN line > 0 AND rule THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS front
  FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
l3 AS (SELECT *, regexp_matches(bare, '^ {{0,3}}(?:`{{3}}|~{{3}})') AND NOT front AS fence FROM l2),
l4 AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS inside FROM l3),
l5 AS (SELECT *, CASE WHEN front THEN 'frontmatter' WHEN fence OR inside = 1 THEN 'code' WHEN regexp_matches(bare, '^\\s*$') THEN 'prose' WHEN regexp_matches(bare, '^#{{1,6}}\\s+\\S') THEN 'heading'
  WHEN regexp_matches(bare, '^\\s*(?:[-*+]|\\d+\\.)\\s+') THEN 'list_item' WHEN regexp_matches(bare, '^\\s*>') THEN 'blockquote'
  WHEN regexp_matches(bare, '^\\s*\\|.+\\|\\s*$') OR regexp_matches(bare, '^\\s*(?:[-*_]\\s*){{3,}}$') THEN 'table' WHEN regexp_matches(bare, '^\\s*</?[A-Za-z][^>]*>') THEN 'html' ELSE 'prose' END AS kind FROM l4),
l6 AS (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY line))::INT, 0) AS fresh FROM l5),
l7 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS seg FROM l6),
sg AS (SELECT doc_id, seg::BIGINT AS seg, any_value(kind) AS kind, string_agg(t, '' ORDER BY line) AS text FROM l7 GROUP BY doc_id, seg)"""
_prose = f"kind IN {words_in(MD.REWRITEABLE)}"
PAIRS = "SELECT doc_id AS pair_id, text AS original, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN substr(text, 1, length(text) // 2) ELSE 'It is a short note. ' || text || ' It ends.' END AS rewritten FROM documents"


def _grams(x: str) -> str:
    chars = f"list_filter(string_split(regexp_replace(lower({x}), '[{SP}]+', ' ', 'g'), ''), lambda c: c <> '')"
    return f"list_transform([{chars}], lambda cs: CASE WHEN len(cs) >= 3 THEN list_transform(list_zip(cs[1:len(cs) - 2], cs[2:len(cs) - 1], cs[3:len(cs)]), lambda z: z[1] || z[2] || z[3]) WHEN len(cs) > 0 THEN [array_to_string(cs, '')] ELSE [] END)[1]"


COMPARE = f"""WITH pr AS ({PAIRS}),
items AS (SELECT pair_id, 'w' AS kind, 0 AS side, unnest({lower_words('original')}) AS x FROM pr UNION ALL SELECT pair_id, 'w', 1, unnest({lower_words('rewritten')}) FROM pr
  UNION ALL SELECT pair_id, 'g', 0, unnest({_grams('original')}) FROM pr UNION ALL SELECT pair_id, 'g', 1, unnest({_grams('rewritten')}) FROM pr),
per AS (SELECT pair_id, kind, x, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM items GROUP BY ALL),
ag AS (SELECT pair_id, kind, CASE WHEN sum(p * p) > 0 AND sum(q * q) > 0 THEN sum(p * q) / (sqrt(sum(p * p)::DOUBLE) * sqrt(sum(q * q)::DOUBLE)) ELSE 0 END AS cosine, sum(least(p, q)) AS common, sum(p) AS na, sum(q) AS nb,
  count(*) FILTER (p > 0 AND q > 0) / count(*)::DOUBLE AS jac FROM per GROUP BY ALL),
cmp AS (SELECT pr.pair_id, coalesce(w.cosine, 0) AS word_cosine, coalesce(g.cosine, 0) AS char_cosine, 0.55 * coalesce(w.cosine, 0) + 0.45 * coalesce(g.cosine, 0) AS similarity, coalesce(w.jac, 1) AS unigram_jaccard,
  CASE WHEN coalesce(w.na, 0) = 0 THEN CASE WHEN coalesce(w.nb, 0) > 0 THEN 1 ELSE 0 END ELSE 1 - w.common / greatest(w.na, w.nb)::DOUBLE END AS token_change_rate,
  length(rewritten) / greatest(1, length(original))::DOUBLE AS length_ratio, coalesce(w.na, 0)::BIGINT AS original_tokens, coalesce(w.nb, 0)::BIGINT AS rewritten_tokens
  FROM pr LEFT JOIN (SELECT * FROM ag WHERE kind = 'w') w USING (pair_id) LEFT JOIN (SELECT * FROM ag WHERE kind = 'g') g ON g.pair_id = pr.pair_id)"""
#: Each pair's sides as two documents.
SIDES = f"SELECT pair_id * 2 AS doc_id, original AS text FROM ({PAIRS}) UNION ALL SELECT pair_id * 2 + 1, rewritten FROM ({PAIRS})"
GATE = f"""gate AS (SELECT cmp.*, a.flesch AS readability_before, b.flesch AS readability_after, round_even(token_change_rate * greatest(original_tokens, rewritten_tokens), 0)::BIGINT AS changed_tokens,
  concat_ws(',', CASE WHEN similarity < 0.82 THEN 'similarity' END, CASE WHEN length_ratio > 1.45 THEN 'too long' END, CASE WHEN length_ratio < 0.62 THEN 'too short' END,
    CASE WHEN b.flesch < 20 AND b.flesch + 15 < a.flesch THEN 'readability' END, CASE WHEN {strip('rewritten')} = '' THEN 'empty' END) AS reasons
  FROM cmp JOIN pr USING (pair_id) JOIN flesch a ON a.doc_id = pair_id * 2 JOIN flesch b ON b.doc_id = pair_id * 2 + 1)"""
WINDOWED = f"""SELECT doc_id * 1000000 + win AS doc_id, array_to_string(toks[win * 128 + 1 : win * 128 + 256], ' ') AS text FROM (
  SELECT doc_id, toks, unnest(range(0, greatest(0, ceil((len(toks) - 256) / 128.0))::BIGINT + 1)) AS win FROM (SELECT doc_id, regexp_extract_all({INJECTED}, '{TOK}') AS toks FROM documents))"""

_reported = {"classical": ("classical", ["classical"]), "stylometric": ("stylometric", ["stylometric", "rich", "sl", "fit", "st", "sd", "adj", "bi"]), "statistical": ("stat", ["stat"])}
_signals = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS name, '{D.MEMBERS[name]}' AS family, {name}_score AS score, {name}_confidence AS confidence, '{k}' AS signal, {table + '.' if k == 'n' else ''}{k} AS value, {w} AS weight FROM {tables[0]}"
    + "".join(f" JOIN {x} USING (doc_id)" for x in tables[1:])
    for name, (table, tables) in _reported.items() for k, w in D.REPORTED[name].items()
)

_edit_select = f"""
SELECT doc_id, pos::BIGINT AS pos, tok, priority::DOUBLE AS priority, place::BIGINT AS place FROM h3 WHERE priority >= 0.25 AND place <= greatest(1, round_even(k * 0.31, 0)::BIGINT)"""
_edit_sql = query([RANKS], f""", h0 AS (SELECT doc_id, pos, tok, rank, CASE WHEN NOT regexp_matches(tok, '^\\p{{L}}+$') OR length(tok) < 4 THEN 0.05 WHEN rank IS NULL THEN 0.92 WHEN rank <= 80 THEN 0.08 WHEN rank <= 250 THEN 0.45 ELSE 0.78 END AS hint FROM t LEFT JOIN ranks ON tok = word),
h1 AS (SELECT *, CASE WHEN lag(hint) OVER (PARTITION BY doc_id ORDER BY pos) > 0.6 THEN least(1.0, hint + 0.08) ELSE hint END AS prior FROM h0),
h2 AS (SELECT *, round(prior * CASE WHEN tok IN {words_in(L.FUNCTION_WORDS)} THEN 0.15 WHEN rank <= 80 THEN 0.35 WHEN length(tok) < 4 THEN 0.25 ELSE 1 END, 6) AS priority, count(*) OVER (PARTITION BY doc_id) AS k FROM h1),
h3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, pos) AS place FROM h2)""").replace("\n, h0", ",\nh0") + _edit_select
SWAPPED = Q(phrase_pattern([*L.PHRASE_SWAPS]))
WORDS = r"\p{L}[\p{L}\p{Nl}\p{No}]*(?:''[\p{L}\p{Nl}\p{No}]+)?"

ORACLE_SQL = {
    "token_kind_counts": query([], r"""SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(words)::BIGINT AS n_words, len(list_filter(toks, lambda x: regexp_matches(x, '^\p{Nd}')))::BIGINT AS n_numbers,
  len(list_filter(toks, lambda x: NOT regexp_matches(x, '^[\p{L}\p{Nd}]')))::BIGINT AS n_punct FROM b"""),
    "top_tokens": query([], "SELECT tok, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "sentence_stats": query([], f"SELECT doc_id, n.k AS n_sentences, {R('mean_sl', 'std_sl', 'burstiness', 'length_uniformity')} FROM sl JOIN n USING (doc_id)"),
    "paragraph_stats": f"""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[{SP}]*\\n'), lambda s: {strip('s')}), lambda s: s <> '') AS ps FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || ' ' || chr(10) || 'End.' ELSE text END AS text FROM documents))
SELECT doc_id, len(ps)::BIGINT AS n_paragraphs, coalesce(list_max(list_transform(ps, lambda s: length(s))), 0)::BIGINT AS longest FROM x""",
    "sanitize_lengths": r"""SELECT doc_id, length(regexp_replace(text || chr(7) || chr(9) || chr(31), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))::BIGINT AS n_clean FROM documents""",
    "char_trigrams": f"SELECT doc_id, len(g)::BIGINT AS n_trigrams, len(list_distinct(g))::BIGINT AS n_distinct FROM (SELECT doc_id, {_grams('text')} AS g FROM documents)",
    "ngram_reuse": query([NEXT, REUSE], f"SELECT doc_id, {R('ngram_reuse')} FROM re"),
    "window_counts": query([], "SELECT doc_id, greatest(0, ceil((len(toks) - 256) / 128.0))::BIGINT + 1 AS n_windows, greatest(0, ceil((len(toks) - 256) / 128.0))::BIGINT * 128 AS last_start FROM b"),
    "readability_richness": query([], f"SELECT rich.doc_id, n, {R('flesch', 'ttr', 'hapax', 'yules_k', 'honores_r')}, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM rich JOIN flesch USING (doc_id) LEFT JOIN labels USING (doc_id)"),
    "zipf_perplexity": query([RANKS, PERPLEXITY], f"SELECT doc_id, {R('perplexity')} FROM ppl"),
    "function_words": query([FUNCTION, FIT], f"SELECT doc_id, {R('function_word_ratio', 'function_word_fit')} FROM fw JOIN fit USING (doc_id)"),
    "phrase_density": query([PHRASES], f"SELECT doc_id, {R('phrase_density')} FROM ph"),
    "opener_scores": query([OPENERS], f"SELECT doc_id, {R('opener_score')} FROM op"),
    "punctuation_uniformity": query([PUNCT], f"SELECT doc_id, {R('punctuation_uniformity')} FROM pu"),
    "bigram_entropy": query([NEXT, BIGRAMS], f"SELECT doc_id, {R('bigram_entropy')} FROM bi"),
    "sentence_flow": query([STARTS, ADJACENT], f"SELECT doc_id, {R('start_diversity', 'adjacent_similarity')} FROM sd JOIN adj USING (doc_id)"),
    "style_ratios": query([STYLE], f"SELECT doc_id, {R('comma_ratio', 'contraction_ratio', 'digit_ratio', 'avg_syllables', 'mean_wl')}, quote_count FROM st"),
    "classical_score": query(CLASSICAL_PARTS, f"SELECT doc_id, n, {R('classical_score', 'classical_confidence')} FROM classical"),
    "stylometric_score": query(STYLOMETRIC_PARTS, f"SELECT doc_id, n, {R('stylometric_score', 'stylometric_confidence')} FROM stylometric"),
    "green_scan": query([NEXT, SCAN], "SELECT doc_id, max_z, mean_abs_z, z_std, mean_rate, max_rate, best_seed::BIGINT AS best_seed FROM scan"),
    "context_consistency": query([NEXT, CONSISTENCY], f"SELECT doc_id, {R('context_consistency')} FROM cc"),
    "window_spikes": query([NEXT, SPIKE], f"SELECT doc_id, {R('window_spike')} FROM sp"),
    "rare_alignment": query([RANKS, NEXT, RARE], f"SELECT doc_id, {R('rare_alignment')} FROM ra"),
    "hot_spans": query([NEXT, HOT], f"SELECT doc_id, start::BIGINT AS \"start\", stop::BIGINT AS \"end\", round({clamp('(z - 1) / 4')}, 6) AS score FROM hot WHERE z >= 1.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) <= 12"),
    "statistical_score": query(STATISTICAL_PARTS, f"SELECT doc_id, n, {R('statistical_score', 'statistical_confidence')} FROM stat"),
    "ensemble_score": query(ENSEMBLE_PARTS, f"SELECT doc_id, {R('ensemble_score', 'ensemble_confidence', 'agreement')}, family, label FROM lab"),
    "label_distribution": query(ENSEMBLE_PARTS, "SELECT lang, label, count(*)::BIGINT AS n FROM lab JOIN documents d USING (doc_id) GROUP BY ALL"),
    "windowed_detect": query([CORPUS_RANKS, *CLASSICAL_PARTS[1:]], f"SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS win, n, {R('classical_score', 'classical_confidence')} FROM classical", WINDOWED),
    "markdown_segments": SEGMENTS + f" SELECT doc_id, seg, kind, NOT ({_prose}) AS protected, text FROM sg",
    "prose_only_text": SEGMENTS + f" SELECT md.doc_id, coalesce(x.text, md.text) AS text FROM md LEFT JOIN (SELECT doc_id, string_agg(text, '' ORDER BY seg) AS text FROM sg WHERE {_prose} AND {strip('text')} <> '' GROUP BY 1) x USING (doc_id)",
    "prose_detect": query(STYLOMETRIC_PARTS, f"SELECT doc_id, n, {R('stylometric_score', 'stylometric_confidence')} FROM stylometric", SEGMENTS + f" SELECT md.doc_id, coalesce(x.text, md.text) AS text FROM md LEFT JOIN (SELECT doc_id, string_agg(text, '' ORDER BY seg) AS text FROM sg WHERE {_prose} AND {strip('text')} <> '' GROUP BY 1) x USING (doc_id)"),
    "reconstructed": "SELECT doc_id, CASE WHEN length(text) >= 10 THEN '<' || substr(text, 2, 7) || '>' || substr(text, 11) WHEN length(text) >= 9 THEN '<' || substr(text, 2, 4) || 'lost' || substr(text, 10) WHEN length(text) >= 1 THEN '<' || substr(text, 2) ELSE text END AS text FROM documents",
    "edit_targets": _edit_sql,
    "perturbed_phrases": f"""WITH d AS (SELECT doc_id, lower(text) AS x FROM ({DOCS})), m AS (SELECT doc_id, len(regexp_extract_all(x, '{SWAPPED}'))::BIGINT AS n_edits, regexp_split_to_array(x, '{SWAPPED}')[1] AS before FROM d)
SELECT doc_id, n_edits, CASE WHEN n_edits > 0 THEN length(before) ELSE -1 END::BIGINT AS first_start, true AS restores, 'phrases' AS strategy FROM m""",
    "perturbed_markdown": SEGMENTS + f""" SELECT md.doc_id, coalesce(x.text, md.text) AS perturbed, 0::BIGINT AS n_failed, coalesce(x.text, md.text) <> md.text AS changed FROM md LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN {_prose} AND {strip('text')} <> '' THEN translate(text, 'aeiou', '43102') ELSE text END, '' ORDER BY seg) AS text FROM sg GROUP BY 1) x USING (doc_id)""",
    "perturbed_words": _edit_sql.removesuffix(_edit_select) + f""",
o AS (SELECT word, list_filter([lead(word) OVER (ORDER BY rank), lead(word, 2) OVER (ORDER BY rank)], lambda x: x IS NOT NULL) AS options FROM ranks),
roll AS (SELECT doc_id, pos, place, priority, k, options, ('0x' || substr(md5(concat_ws(chr(31), '13', doc_id, pos, 'keep')), 1, 7))::BIGINT / 268435456.0 AS u,
  options[('0x' || substr(md5(concat_ws(chr(31), '13', doc_id, pos, 'choice')), 1, 7))::BIGINT % len(options) + 1] AS new FROM h3 JOIN o ON tok = word WHERE len(options) > 0),
new AS (SELECT doc_id, pos, new FROM roll WHERE priority >= 0.25 AND place <= greatest(1, round_even(k * 0.31, 0)::BIGINT) AND u >= 0.55::DOUBLE - 0.35::DOUBLE * 0.42::DOUBLE),
wp AS (SELECT doc_id, text, regexp_extract_all(text, '{WORDS}') AS toks, regexp_split_to_array(text, '{WORDS}') AS gaps FROM docs),
w AS (SELECT doc_id, gaps[pos] AS gap, toks[pos] AS own, pos FROM (SELECT doc_id, toks, gaps, unnest(generate_series(1, len(toks))) AS pos FROM wp)),
cased AS (SELECT doc_id, pos, gap, own, CASE WHEN new IS NULL THEN own WHEN own = upper(own) AND own <> lower(own) THEN upper(new)
  WHEN substr(own, 1, 1) = upper(substr(own, 1, 1)) AND substr(own, 1, 1) <> lower(substr(own, 1, 1)) THEN upper(substr(new, 1, 1)) || substr(new, 2) ELSE new END AS word, new FROM w LEFT JOIN new USING (doc_id, pos)),
built AS (SELECT doc_id, string_agg(gap || word, '' ORDER BY pos) AS body, count(new) AS n FROM cased GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_edits, md5(text) AS original, md5(coalesce(body, '') || gaps[len(gaps)]) AS digest, true AS restores FROM wp LEFT JOIN built USING (doc_id)""",
    "pair_compare": COMPARE + f" SELECT pair_id, {R('similarity', 'word_cosine', 'char_cosine', 'unigram_jaccard', 'token_change_rate', 'length_ratio')}, original_tokens, rewritten_tokens FROM cmp",
    "quality_gate": query([COMPARE.removeprefix("WITH "), GATE], f"SELECT pair_id, {R('readability_before', 'readability_after')}, changed_tokens, 'ngrams' AS method, reasons, reasons = '' AS passed FROM gate", SIDES),
    "evaluated_pairs": query([CORPUS_RANKS if x == RANKS else x for x in ENSEMBLE_PARTS] + [COMPARE.removeprefix("WITH "), GATE], """SELECT pair_id, round(a.ensemble_score, 6) AS before, round(b.ensemble_score, 6) AS after, round(b.ensemble_score - a.ensemble_score, 6) AS delta,
  a.label AS before_label, b.label AS after_label, reasons = '' AS passed, reasons = '' AND b.ensemble_score <= 0.40 AS target_met
  FROM gate JOIN lab a ON a.doc_id = pair_id * 2 JOIN lab b ON b.doc_id = pair_id * 2 + 1""", SIDES),
    "detector_records": query(ENSEMBLE_PARTS, f"""SELECT doc_id, name, family, round(score::DOUBLE, 6) AS score, round(confidence::DOUBLE, 6) AS confidence,
  CASE WHEN confidence = 0 THEN 'uncertain' WHEN family = 'watermark' AND score >= 0.70 THEN 'watermarked' WHEN family <> 'watermark' AND score >= 0.62 THEN 'ai' WHEN score >= 0.45 THEN 'uncertain' ELSE 'human' END AS label,
  signal, round(value::DOUBLE, 6) AS value, weight::DOUBLE AS weight FROM ({_signals})"""),
    "promoted_spans": query([NEXT, HOT], f"""SELECT doc_id, place, "start", "end", round(score, 6) AS score FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) - 1 AS place, start::BIGINT AS "start", stop::BIGINT AS "end", score FROM (
    SELECT doc_id, start, stop, {clamp('(z - 1) / 4')} AS score FROM hot WHERE z >= 1.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) <= 12)) WHERE place < 16"""),
    "prose_chunks": r"""WITH p AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?]) ', '\1' || chr(10) || chr(10), 'g'), '(
\s*
)', '\1' || chr(1), 'g'), chr(1)), lambda x: [x]) AS ps FROM documents),
c AS (SELECT doc_id, list_filter(list_reduce(ps, lambda a, x: CASE WHEN length(a[len(a)]) + length(x[1]) <= 300 THEN list_append(a[1:len(a) - 1], a[len(a)] || x[1]) ELSE list_append(a, x[1]) END), lambda x: x <> '') AS c FROM p)
SELECT doc_id, len(c)::BIGINT AS n_chunks, coalesce(list_max(list_transform(c, lambda x: length(x))), 0)::BIGINT AS longest, md5(array_to_string(c, '|')) AS digest FROM c""".replace("\\\\", "\\"),
    "protected_offsets": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' https://a.example/x?y=jo@b.example and q@c.example ' ELSE text END AS x FROM documents),
m AS ({' UNION ALL '.join(f"SELECT doc_id, i, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s FROM (SELECT doc_id, hits, gaps, unnest(generate_series(1, len(hits))) AS i FROM (SELECT doc_id, regexp_extract_all(x, '{Q(p)}') AS hits, regexp_split_to_array(x, '{Q(p)}') AS gaps FROM d))" for p in (T.URL, T.EMAIL))}),
s AS (SELECT doc_id, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM m),
f AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, min(s) AS "start", max(e) AS "end" FROM g GROUP BY doc_id, island""",
    "overlapping_spans": "SELECT doc_id, (doc_id % 50 < 20 AND doc_id % 50 + 3 > 10) OR (doc_id % 50 < 31 AND doc_id % 50 + 3 > 30) AS hit FROM documents",
    "finite_units": f"SELECT doc_id, round(CASE WHEN doc_id % 4 < 2 THEN 0.25 ELSE {clamp('n_chars / 1000.0 - 0.5')} END::DOUBLE, 6) AS unit FROM documents",
    "matched_casing": f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END, '{TOK}'), lambda x: {WORD})) AS w FROM documents)
SELECT doc_id, CASE WHEN w = upper(w) AND w <> lower(w) THEN 'ÉXAMPLE' WHEN substr(w, 1, 1) = upper(substr(w, 1, 1)) AND substr(w, 1, 1) <> lower(substr(w, 1, 1)) THEN 'Éxample' ELSE 'éxample' END AS word, count(*)::BIGINT AS n FROM w GROUP BY ALL""",
    "joined_sentences": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;] '), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(s, lambda x, i: CASE WHEN i = len(s) OR regexp_matches(x, '[.!?:;]$') THEN x ELSE x || '.' END), ' ') AS j FROM s)
SELECT doc_id, md5(j) AS digest, length(j)::BIGINT AS chars FROM j""",
    "outer_space": f"""SELECT doc_id, CASE WHEN {strip('x')} = '' THEN x ELSE regexp_extract(x, '^[{SP}]*') || 'new' || regexp_extract(x, '[{SP}]*$') END AS text FROM (
  SELECT doc_id, ' ' || chr(10) || chr(9) || text || chr(10) || ' ' AS x FROM documents)""",
    "image_provenance": f"""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, x, strlen(x)::BIGINT AS n FROM ({PACKETS}))
SELECT doc_id, ['png', 'jpeg', 'webp', 'tiff'][kind + 1] AS format, CASE kind WHEN 0 THEN 'text,xmp' WHEN 1 THEN 'exif,tag' || repeat(',comment', ceil(n / {COMMENT_BYTES})::INT) WHEN 2 THEN 'xmp' ELSE 'tag,xmp' END AS kinds,
  [92, 51, 20, 47][kind + 1]::BIGINT AS first_start, ([92, 51, 20, 47][kind + 1] + n + CASE kind WHEN 1 THEN 4 * (ceil(n / {COMMENT_BYTES}) - 1) ELSE 0 END)::BIGINT AS last_end, md5(x) AS digest, true AS whole FROM d""",
    "claim_assertions": """WITH d AS (SELECT doc_id, text, strlen(text) AS n, 'urn:' || doc_id AS name, strlen(doc_id::VARCHAR) AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
a AS (SELECT *, 41 + 8 + (8 + 17 + 5) + 8 + (8 + 17 + 5 + w) + 8 + (8 + 17 + 16) + 8 + (8 + 17 + 13) + 8 AS s FROM d),
b AS (SELECT *, s + 11 + n + 8 + (8 + 17 + 29) + 8 AS t FROM a)
SELECT doc_id, name AS manifest, 'c2pa.actions' AS label, 'cbor' AS content, s::BIGINT AS start, (11 + n)::BIGINT AS size, md5(text) AS digest FROM b
UNION ALL SELECT doc_id, name, 'stds.schema-org.CreativeWork', 'json', t::BIGINT, (11 + w)::BIGINT, md5(doc_id::VARCHAR) FROM b
UNION ALL SELECT doc_id, name, 'c2pa.claim', 'cbor', (t + 11 + w + 8 + (8 + 17 + 11) + 8)::BIGINT, 15::BIGINT, md5('inkgauge') FROM b""",
    "pdf_provenance": f"""WITH d AS (SELECT doc_id, x, strlen(x)::BIGINT AS n, '2 0 obj' || chr(10) || '<< /Producer (inkgauge \\(' || doc_id || '\\)) /Title <' || hex(doc_id::VARCHAR) || '> >>' || chr(10) || 'endobj' AS info FROM ({PACKETS})),
e AS (SELECT *, 61::BIGINT AS s, 61 + strlen(info)::BIGINT AS t FROM d)
SELECT doc_id, 'info' AS kind, 'Producer' AS name, 'inkgauge (' || doc_id || ')' AS value, s AS start, t AS "end", md5(info) AS digest, true AS whole FROM e
UNION ALL SELECT doc_id, 'info', 'Title', doc_id::VARCHAR, s, t, md5(info), true FROM e
UNION ALL SELECT doc_id, 'xmp', '', '', t + 1 + 49 + strlen(n::VARCHAR) + 11, t + 1 + 49 + strlen(n::VARCHAR) + 11 + n, md5(x), true FROM e""",
    "suffix_kinds": """SELECT page_id, ['html', 'image', 'pdf', 'text', 'other', 'other'][page_id % 6 + 1] AS kind, page_id || ['.HTML', '.png', '.pdf', '.md', '.tar.gz', ''][page_id % 6 + 1] || '.out' AS name FROM pages""",
    "event_rates": "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL",
    "embedding_cosine": "SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "protected_spans": f"SELECT doc_id, len(regexp_extract_all(x, '{Q(T.URL)}'))::BIGINT AS urls, len(regexp_extract_all(x, '{Q(T.EMAIL)}'))::BIGINT AS emails FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' see https://a.example/x?y=1 ' ELSE text END AS x FROM documents)",
    "provenance_audit": f"""SELECT page_id, len(regexp_extract_all(h, '{Q(P.HTML_META)}'))::BIGINT AS metas, len(regexp_extract_all(h, '{Q(P.HTML_LINK)}'))::BIGINT AS links,
  len(list_filter(regexp_extract_all(h, '{Q(P.JSON_LD)}'), lambda x: regexp_matches(lower(x), 'c2pa|contentcredentials|digitalsourcetype|prov:')))::BIGINT AS json_ld,
  len(regexp_extract_all(h, '{Q(P.XMP)}'))::BIGINT AS xmp, ({' + '.join(f"contains(lower(h), '{m}')::INT" for m in P.ASCII_MARKERS)})::BIGINT AS markers
  FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, '<head>', '{Q(MARKS)}') ELSE html END AS h FROM pages)""",
    "corpus_report": query([], "SELECT lang, source, count(*)::BIGINT AS docs, sum(n)::BIGINT AS words, round(avg(flesch), 6) AS flesch, round(avg(ttr), 6) AS ttr FROM rich JOIN flesch USING (doc_id) JOIN documents d USING (doc_id) GROUP BY ROLLUP (lang, source)"),
    "score_vs_labels": query(STYLOMETRIC_PARTS, "SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*)::BIGINT AS docs, round(avg(stylometric_score), 6) AS mean_score FROM stylometric JOIN labels USING (doc_id) GROUP BY ALL"),
    "scalar_math": f"""SELECT doc_id, round({log('n_chars', 1500, 0.001)}, 6) AS logistic, round({clamp('n_chars / 3000.0')}, 6) AS clamped, round({band('n_chars::DOUBLE', 500.0, 1500.0)}::DOUBLE, 6) AS band FROM documents""",
    "keyed_uniform": "SELECT doc_id, round(('0x' || substr(md5(concat_ws(chr(31), '13', doc_id::VARCHAR, lang)), 1, 7))::BIGINT / 268435456.0, 6) AS u FROM documents",
    "json_rows": "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS json FROM documents",
}
