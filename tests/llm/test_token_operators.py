"""Token files, tokenizer alignment and resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from inkgauge.llm import alignment, resample, token_files
from inkgauge.llm._shared import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, shard string, pairs int, partial boolean"
TEXTS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (4, "one two three"), (4, "other words"), (5, "One two\nTHREE  <|endoftext|> <s>"), (None, "no id"),
    (6, "x" * 5000), (7, " ".join(f"w{i}" for i in range(3000))), (8, "naïve 漢字 🎉 don't  stop\n\n now "), (9, "▁ held ▁"), (10, "a \xa0 \xa0 b"), (11, " lead"),
    (12, "trail  "), (13, "nul\x00 byte \x1c a\x85 z"), (14, "The cat sat on the mat, and the cat sat again. " * 40), (-3, "below zero"), (15, " "),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, True) for i, t in TEXTS], DOCS)


# op11


@pytest.mark.parametrize("width", [1, 5, 15, 16, 17, 31, 32])
def test_bits_round_trip(width):
    for n in (0, 1, 31, 32, 33, 5000):
        ids = np.random.default_rng(n).integers(0, 1 << width, n, np.uint64).astype(np.uint32)
        data = token_files.pack_bits(ids, width)
        assert len(data) == -(-n // 32) * 4 * width
        assert token_files.unpack_bits(data, width)[:n].tolist() == ids.tolist()
    assert token_files.bits_for(1 << width) == width


@pytest.mark.parametrize("width", [8, 16, 32])
def test_ids_of_whole_bytes_lie_as_numbers(width, monkeypatch):
    ids = np.random.default_rng(width).integers(0, 1 << width, 100, np.uint64).astype(np.uint32)
    # bit by bit, lowest first
    bits = np.unpackbits(np.pad(ids, (0, 28)).astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    want = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    monkeypatch.setattr(token_files, "divmod", None, raising=False)  # no loop over places
    assert token_files.pack_bits(ids, width) == want
    assert token_files.unpack_bits(want, width)[:100].tolist() == ids.tolist() and token_files.unpack_bits(want, width).dtype == np.uint32


def test_shards_give_any_run(tmp_path):
    rng = np.random.default_rng(5)
    lengths = [1, 3000, 1, 1024, 7, 2500]
    ids = rng.integers(0, 1 << 17, sum(lengths)).astype(np.uint32)
    file = tmp_path / "shard"
    file.write_bytes(token_files.shard_bytes([5, None, 7, 8, 9, 9], lengths, ids, 17, 3, 4) + b"\n")
    shard = token_files.Shard(np.memmap(file, np.uint8, "r"))
    assert (shard.partition, shard.number, shard.n_ids) == (3, 4, len(ids)) and shard.has_id.tolist() == [True, False, True, True, True, True]
    for a, b in [(0, 0), (0, 1), (1023, 1025), (3001, 6000), (5, len(ids)), (len(ids) - 1, len(ids) + 9)]:
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    starts = np.cumsum([0, *lengths])
    assert [shard.document(i).tolist() for i in range(6)] == [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
    with pytest.raises(ValueError):
        token_files.Shard(file.read_bytes()[:500])
    with pytest.raises(ValueError):
        token_files.Shard(b"\n" * 200)


def brute_ids(text):
    from tokenizers import Tokenizer

    global TOK
    TOK = globals().get("TOK") or Tokenizer.from_file(PATH_A)
    return TOK.encode(text or "", add_special_tokens=False).ids + [2]


def test_files_hold_all_ids_in_order(spark, docs):
    path = scratch_path(spark, "token-test")
    got = token_files.round_trip(docs.repartition(3), PATH_A, path).collect()
    at, want = 0, Counter((i, len(brute_ids(t)), zlib.crc32(np.array(brute_ids(t), "<u4").tobytes())) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    rows = sorted(got, key=lambda r: r["start"])
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(-math.inf if r["doc_id"] is None else r["doc_id"]) for r in rows]
    assert order == sorted(order)
    # The same files hold the ids themselves, and small shards give the same starts.
    whole = {(r["doc_id"], r["ids_crc32"]): np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_tokens(spark, path).collect()}
    assert whole[7, zlib.crc32(np.array(brute_ids(TEXTS[9][1]), "<u4").tobytes())] == brute_ids(TEXTS[9][1])
    small = scratch_path(spark, "token-test")
    token_files.write_tokens(docs, PATH_A, small, shard_ids=100)
    again = token_files.token_starts(token_files.read_tokens(spark, small, with_ids=False)).collect()
    assert len({r["path"] for r in again}) > 3
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in again} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in got}


def test_files_of_an_empty_table(spark, docs):
    assert token_files.round_trip(docs.where("false"), PATH_A, scratch_path(spark, "token-test")).collect() == []


# op12


def brute_alignment(texts):
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    from inkgauge.llm.packing import _byte_of_char

    tok, model, byte = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B), _byte_of_char()
    tok.encode_special_tokens = True
    vocab = {i: bytes(byte[c] for c in t) for t, i in json.loads(tok.to_str())["model"]["vocab"].items() if all(c in byte for c in t)}
    rows = []
    for text in texts:
        groups, links = [], []
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text, num_threads=1) if text else []
        spell = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        ea, eb = np.cumsum([len(vocab[i]) for i in a]).tolist(), np.cumsum([len(spell(i)) for i in b]).tolist()
        want = (" " + text).encode() if text else b""
        if b"".join(vocab[i] for i in a) != want or b"".join(map(spell, b)) != want:
            a, b, ea, eb = [], [], [], []
        cuts = sorted(set(ea) & set(eb))
        for low, high in zip([0, *cuts], cuts, strict=False):
            x, y = [i for i, e in zip(a, ea, strict=True) if low < e <= high], [i for i, e in zip(b, eb, strict=True) if low < e <= high]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links.append((x[-1], y[-1]))
        rows.append((len(a), len(b), ";".join(groups), links))
    counts = Counter(x for *_, links in rows for x in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return counts, [
        (na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if na else "", g)
        for na, nb, g, links in rows
    ]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_a_plain_one(spark, docs, small, monkeypatch):
    if small:
        for name in ("SLICE_CHARS", "TABLE_SEGMENTS", "JOIN_TOKENS", "PARTIAL_PAIRS"):
            monkeypatch.setattr(alignment, name, 40)
        rows = alignment.Aligner(PATH_A, PATH_B)
        units = [u for _, t in TEXTS if t for u in rows.slices(t)]
        assert len(units) > len(TEXTS) and " ".join(rows.slices(TEXTS[9][1])) == TEXTS[9][1]
        cut = [rows.segments(u) for u in units]
        texts = [b";".join(rows.texts[p] for p in places) for u in cut for places in rows.look([u])]
        want = brute_alignment([t for _, t in TEXTS])[1]
        at = 0
        for (_, t), w in zip(TEXTS, want, strict=True):
            n = len([*rows.slices(t)]) if t else 0
            if w[0]:
                assert b";".join(texts[at : at + n]).decode() == w[7]
            at += n
        return
    found, pairs = alignment.align(docs.repartition(2), PATH_A, PATH_B, with_groups=True)
    counts, want = brute_alignment([t for _, t in TEXTS])
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in found.collect()) == Counter((i, *w) for (i, _), w in zip(TEXTS, want, strict=True))
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == counts
    assert len(counts) <= alignment.pair_bound(PATH_A, PATH_B)
    zero = {i for (i, t), w in zip(TEXTS, want, strict=True) if t and not w[0]}
    assert zero == {9}


def test_alignment_of_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in alignment.align(rows, PATH_A, PATH_B)[0].collect()}
    texts = rows.select("doc_id", "text").collect()
    for r, w in zip(texts, brute_alignment([r["text"] for r in texts])[1], strict=True):
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == w[:7]


def test_alignment_of_an_empty_table(spark, docs):
    found, pairs = alignment.align(docs.where("false"), PATH_A, PATH_B)
    assert found.collect() == [] and pairs.collect() == []


# op13


def brute_resample(docs, target, longest, buckets, least, percent, seed):
    def words(t):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in target for f in features(x))
    gain = lambda f: math.floor(1000 * math.log((t[f] + 1.0) * (s.total() + buckets) / ((s[f] + 1.0) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, features(x)))
        rows.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("longest,least,percent", [(1, 2, 40), (3, 0, 100), (2, 1, 7), (1, 10_000, 50)])
def test_resample_equals_a_plain_one(spark, docs, longest, least, percent):
    target = ["the CAT sat", None, "", "w5 w6 w7 naïve", "▁"]
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=500, least_words=least, percent=percent, seed=3)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute_resample(TEXTS, target, longest, 500, least, percent, 3)


def test_resample_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs.where("false"), none).collect() == []
    got = resample.resample(docs, none, least_words=2).collect()
    assert len(got) == len(TEXTS) and sum(r["rank"] is not None for r in got) == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")) >= 2 for _, t in TEXTS) // 10


def test_the_kth_key_is_exact(spark):
    rng = np.random.default_rng(2)
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 65536, 65535]
    rows = [(int(s), int(t)) for s, t in zip(rng.choice([*edge, *rng.integers(-(1 << 40), 1 << 40, 30).tolist()], 300), rng.choice([*edge[:5], *range(40)], 300), strict=True)]
    rows += [(7, None), (7, None), (7, 1)]
    df = spark.createDataFrame(rows, "score long, doc_id long")
    order = sorted(rows, key=lambda r: (-r[0], (1 << 63) - 1 if r[1] is None else r[1]))
    for k in (1, 2, 50, 151, 302, 303):
        want = order[k - 1]
        assert resample.kth_key(df, "score", "doc_id", k) == (want[0], (1 << 63) - 1 if want[1] is None else want[1])
    assert resample.kth_key(df, "score", "doc_id", 304) is None
