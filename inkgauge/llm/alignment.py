"""Alignment of two tokenizers over the same bytes.

Each text, with a blank before it, is cut into tokens by A (a byte-level `tokenizers` file) and by B (a `sentencepiece` model). Where tokens
of both end at one byte the text is cut into groups; the two tokens that end there are linked.

At a single blank between other characters both tokenizers begin a token, so what lies between such blanks, a segment, is aligned alike wherever it
occurs. A task aligns each unlike segment once (in a bounded table): the segments' tokens become two interval tables, end
to end, and DuckDB joins them within the task. An ASOF join finds the B token that holds each A token's last byte, a window sum numbers
the groups, a range join gives each group its B tokens, and an ASOF join names the segment. Documents are put
together from their segments, with their pairs of linked ids counted; tasks sum these counts (in DuckDB too) and Spark merges the
partial sums. The merged table goes back to the tasks: of a linked pair one token's bytes end the other's, so there are never
more pairs than the bytes of both vocabularies, however large the corpus (`pair_bound`).

Defined results: null and empty texts, and those whose tokens don't spell the same bytes in A or B (such as texts that hold U+2581), have no
tokens: zeros, and no groups; rows alike have results alike; rows without an id keep a null id; an empty table gives no rows; texts of any length are
taken whole, in slices cut between segments; a segment of any length has its tables cut between groups; extra columns aren't kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .packing import _byte_of_char, plain_engine

#: Characters that are aligned at once, segments in a worker's table and the characters they hold, tokens of a join, and pairs that a task sums at once.
SLICE_CHARS, TABLE_SEGMENTS, TABLE_CHARS, JOIN_TOKENS, PARTIAL_PAIRS = 1 << 21, 400_000, 1 << 24, 1 << 18, 1 << 21
#: A single blank between other characters.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")

#: The joins of a task, each into a table of its own, so that the next is planned by true sizes.
STEPS = {
    "met": "SELECT a.i, a.s, a.e, b.id AS b_id, b.e = a.e AS both_end FROM a ASOF JOIN b ON a.e > b.s",
    "numbered": "SELECT *, coalesce(sum(both_end::INT) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM met",
    "spans": "SELECT g, min(s) AS s, max(e) AS e FROM numbered GROUP BY g",
    "filled": "SELECT b.i, spans.g FROM spans JOIN b ON b.s >= spans.s AND b.s < spans.e",
}
#: What is read of them: each A token's group and, where both end, the B token; each B token's group; the segment of each group.
READ = (
    "SELECT g, both_end, b_id FROM numbered ORDER BY i",
    "SELECT g FROM filled ORDER BY i",
    "SELECT seg.k FROM spans ASOF JOIN seg ON spans.s >= seg.s ORDER BY g",
)

_aligners: dict[tuple[str, str], Aligner] = {}


def _a_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level file; 0 where there is none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    out = np.zeros(1 + max([*spec["model"]["vocab"].values(), *added]), np.int64)
    for token, i in spec["model"]["vocab"].items():
        out[i] = len(token) if i not in added else len(added[i].encode())
    return out


def _b_bytes(path: str) -> list[bytes]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


def pair_bound(path_a: str, path_b: str) -> int:
    """The most pairs of ids that can be linked: one of a pair's tokens is one of the other's endings."""
    return int(_a_lengths(path_a).sum()) + sum(map(len, _b_bytes(path_b)))


class Aligner:
    """Segments' alignments, held in a table; of one worker."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb
        import sentencepiece

        self.encode_a, self.b = plain_engine(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab, byte = json.load(f)["model"]["vocab"], _byte_of_char()
        self.a_bytes = [b""] * len(_a_lengths(path_a))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = _b_bytes(path_b)
        self.a_len, self.b_len = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        # Segments stand alone only if no token goes over a blank into what follows.
        self.cuts = not any(re.search(r"[^ ] (?!\s)", x.decode(errors="replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.duck = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.names = [b"%d" % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.pieces = [n + mark for mark in (b",", b"|", b";", b"") for n in self.names]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, whether the bytes agree
        self.starts, self.pairs, self.chars = np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def segments(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def slices(self, text: str) -> Iterator[str]:
        """The text in slices that end between segments."""
        at = 0
        while self.cuts and len(text) - at > SLICE_CHARS and (m := CUT.search(text, at + SLICE_CHARS)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def spelt(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        return b"".join([self.a_bytes[i] for i in a.tolist()]), b"".join([self.b_bytes[i] for i in b.tolist()])

    def learn(self, new: list[str]) -> None:
        """Adds unlike segments to the table."""
        # Segments that begin and end with other characters than blanks are encoded as one text, which is cut where they end.
        plain = [w for w in new if self.cuts and w and not w[0].isspace() and w[-1] != " "]
        flat_a, flat_b, n_a, n_b, odd = [], [], [], [], new
        if plain:
            text, ends = " ".join(plain), np.cumsum([1 + len(w.encode()) for w in plain])
            a, b = np.array(self.encode_a(" " + text), np.int64), np.array(self.b.encode(text, num_threads=1), np.int64)
            if self.spelt(a, b) == (b" " + text.encode(),) * 2:
                for ids, lengths, flat, n in ((a, self.a_len, flat_a, n_a), (b, self.b_len, flat_b, n_b)):
                    flat.append(ids)
                    n += np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends) + 1, prepend=0).tolist()
                held = set(plain)
                odd = [w for w in new if w not in held]
            else:
                plain = []
        bad = []
        for w in odd:
            a, b = np.array(self.encode_a(" " + w), np.int64), np.array(self.b.encode(w, num_threads=1), np.int64)
            if self.spelt(a, b) == (b" " + w.encode(),) * 2:
                plain.append(w)
                for ids, flat, n in ((a, flat_a, n_a), (b, flat_b, n_b)):
                    flat.append(ids)
                    n.append(len(ids))
            else:
                bad.append(w)
        counts, texts, pairs = np.zeros((len(new), 4), np.int64), [], []
        if plain:
            a, b = np.concatenate(flat_a), np.concatenate(flat_b)
            ends_a = np.cumsum(self.a_len[a])
            starts = np.concatenate([[0], ends_a[np.cumsum(n_a) - 1][:-1]])
            groups = np.zeros(len(plain), np.int64)
            for k, text, found in self.aligned(a, ends_a, b, np.cumsum(self.b_len[b]), starts):
                if k[0] < len(texts):  # a part begins within a segment, whose groups go on
                    texts[-1] += b";" + text[0]
                    text = text[1:]
                texts += text
                groups += np.bincount(k, minlength=len(plain))
                pairs.append(found)
            counts[: len(plain)] = np.stack([n_a, n_b, groups, np.ones(len(plain), np.int64)], 1)
        texts += [b""] * len(bad)
        first = len(self.texts)
        self.index.update(zip(plain + bad, range(first, first + len(new)), strict=True))
        self.texts += texts
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[:, 2])])
        self.pairs = np.concatenate([self.pairs, *pairs])
        self.chars += sum(map(len, new))

    def aligned(self, a, ends_a, b, ends_b, starts) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """STEPS over the token tables, cut between groups into parts of some JOIN_TOKENS tokens.

        Of each part: the segment of each group (segments begin at the bytes `starts`), the groups' ids as text by segment, and the linked pairs.
        """
        i = j = 0
        while i < len(a):
            # The part ends at a byte where tokens of both end.
            stop_i, step = len(a), JOIN_TOKENS
            while i + step < len(a):
                both = np.flatnonzero(np.isin(ends_a[i : i + step], ends_b[j : j + 2 * step], assume_unique=True))
                if len(both):
                    stop_i = i + int(both[-1]) + 1
                    break
                step *= 2
            end = int(ends_a[stop_i - 1])
            stop_j = int(np.searchsorted(ends_b, end)) + 1
            x, y = a[i:stop_i], b[j:stop_j]
            for name, ids, ends, lengths in (("a", x, ends_a[i:stop_i], self.a_len), ("b", y, ends_b[j:stop_j], self.b_len)):
                self.duck.register(name, pa.table({"i": np.arange(len(ids)), "id": ids, "s": ends - lengths[ids], "e": ends}))
            low, high = np.searchsorted(starts, int(ends_a[i - 1]) if i else 0, "right") - 1, np.searchsorted(starts, end)
            self.duck.register("seg", pa.table({"k": np.arange(low, high), "s": starts[low:high]}))
            for step, query in STEPS.items():
                self.duck.execute(f"CREATE OR REPLACE TEMP TABLE {step} AS {query}")
            of_a, of_b, of_group = (self.duck.sql(query).to_arrow_table() for query in READ)
            g, ends, g_b, k = of_a["g"].to_numpy(), of_a["both_end"].to_numpy(), of_b["g"].to_numpy(), of_group["k"].to_numpy()
            yield k, self.written_out(x, y, g, g_b, k), x[ends] * len(self.b_bytes) + of_a["b_id"].to_numpy()[ends]
            i, j = stop_i, stop_j

    def written_out(self, a, b, g_a, g_b, k) -> list[bytes]:
        """The groups as text, by segment: A's ids, a bar, B's ids, and a semicolon before the next group."""
        in_a, in_b = np.bincount(g_a, minlength=len(k)), np.bincount(g_b, minlength=len(k))
        at_a, at_b = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[g_a], np.arange(len(b)) + np.cumsum(in_a)[g_b]
        code = np.zeros(len(a) + len(b), np.int64)
        code[at_a], code[at_b] = a, b
        size, ends = len(self.names), np.cumsum(in_a + in_b)
        mark = np.zeros(len(code), np.int64)
        mark[ends - in_b - 1], mark[ends - 1] = 1, np.where(np.append(k[1:] != k[:-1], True), 3, 2)
        pieces = [*map(self.pieces.__getitem__, (code + size * mark).tolist())]
        stops = ends[np.flatnonzero(np.append(k[1:] != k[:-1], True))].tolist()
        return [b"".join(pieces[x:y]) for x, y in zip([0, *stops], stops, strict=False)]

    def look(self, units: list[list[str]]) -> list[np.ndarray]:
        """The places in the table of each unit's segments, which are learnt where they are new; the table is emptied before it grows beyond its bounds."""
        if len(self.index) > TABLE_SEGMENTS or self.chars > TABLE_CHARS:
            self.clear()
        new = {s for u in units for s in u if s not in self.index}
        if new:
            self.learn([*new])
        return [np.fromiter(map(self.index.__getitem__, u), np.int64, len(u)) for u in units]

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unlike pairs of these segments, rising, and how often each is linked."""
        start, size = self.starts[places], self.counts[places, 2]
        before = np.cumsum(size) - size
        return np.unique(self.pairs[np.repeat(start - before, size) + np.arange(int(size.sum()))], return_counts=True)


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], duck) -> tuple[np.ndarray, np.ndarray]:
    duck.register("counted", pa.table({"pair": np.concatenate([p for p, _ in parts]), "n": np.concatenate([n for _, n in parts])}))
    out = duck.sql("SELECT pair, sum(n)::BIGINT AS n FROM counted GROUP BY pair").to_arrow_table()
    return out["pair"].to_numpy(), out["n"].to_numpy()


LAID = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>, partial boolean"


def laid(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A row for each document (LAID, and groups where wanted): its counts, and its unlike pairs a * (ids of B) + b with how often it links them.

    Beside them rows with partial set, whose pairs and times are sums over documents of one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()] + [pa.string()] * with_groups
        partial, weight = [], 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def taken(doc: int | None, parts: list[tuple], groups: list[bytes]) -> tuple:
            """A document's row from its slices' counts and pairs."""
            count = np.sum([c for c, _ in parts], axis=0)
            if not parts or count[3]:
                return (doc, 0, 0, 0, "", [], [], False, *([""] * with_groups))
            pairs, times = parts[0][1] if len(parts) == 1 else _summed([p for _, p in parts], aligner.duck)
            digest = hashlib.sha256()
            for k, g in enumerate(groups):
                digest.update(b";" + g if k else g)
            text = [b";".join(groups).decode()] if with_groups else []
            return (doc, *count[:3].tolist(), digest.hexdigest(), pairs, times, False, *text)

        def aligned(units: list[tuple[int, str]]) -> Iterator[tuple[int, tuple, bytes]]:
            """For each slice its document's place, its counts (with those that don't agree) and pairs, and its groups."""
            cut = [aligner.segments(u) for _, u in units]
            for (k, _), places in zip(units, aligner.look(cut), strict=True):
                count = aligner.counts[places].sum(0)
                count[3] = len(places) - count[3]
                yield k, (count, aligner.pairs_of(places)), b";".join(map(aligner.texts.__getitem__, places.tolist()))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            k = 0
            while k < len(ids):
                # Some SLICE_CHARS characters of whole documents, or one document slice by slice.
                parts, groups, units, chars, first = {}, {}, [], 0, k
                while k < len(ids) and (k == first or chars < SLICE_CHARS):
                    parts[k], groups[k] = [], []
                    text = texts[k].as_py()
                    for s in aligner.slices(text) if text else ():
                        units.append((k, s))
                        chars += len(s)
                        if chars >= SLICE_CHARS:
                            for d, p, g in aligned(units):
                                parts[d].append(p)
                                groups[d].append(g)
                            units = []
                    k += 1
                for d, p, g in aligned(units):
                    parts[d].append(p)
                    groups[d].append(g)
                rows = [taken(ids[d], parts[d], groups[d]) for d in range(first, k)]
                partial += [(r[5], r[6]) for r in rows if len(r[5])]
                weight += sum(len(r[5]) for r in rows)
                yield made(rows)
                if weight > PARTIAL_PAIRS:
                    partial, weight = [_summed(partial, aligner.duck)], 0
        if partial:
            pairs, times = _summed(partial, aligner.duck)
            yield made([(None, 0, 0, 0, "", pairs, times, True, *([""] * with_groups))])

    schema = LAID + (", groups string" if with_groups else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, ids_b: int) -> DataFrame:
    """a_id, b_id, n, best (whether n is the highest of its B id): the tasks' partial sums merged."""
    merged = (
        rows.where("partial").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.times").alias("n")).select(F.expr(f"pair div {ids_b}").alias("a_id"), F.expr(f"pair % {ids_b}").alias("b_id"), "n")
    )
    most = merged.groupBy("b_id").agg(F.max("n").alias("most"))
    return merged.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, where wanted, groups) and the pairs (pair_counts)."""
    spark = docs.sparkSession
    ids_b = len(_b_bytes(path_b))
    rows = written(laid(docs, path_a, path_b, id_col=id_col, text_col=text_col, with_groups=with_groups), "aligned")
    counts = written(pair_counts(rows, ids_b), "pairs")
    # At most pair_bound rows, some hundred thousand for the usual vocabularies.
    table = counts.select((F.col("a_id") * ids_b + F.col("b_id")).alias("pair"), "n", "best").orderBy("pair").toArrow()
    if table.num_rows > pair_bound(path_a, path_b):
        raise ValueError("more linked pairs than there can be")
    known = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            held, times = batch["pairs"], batch["times"].flatten().to_numpy()
            place = np.searchsorted(pair, held.flatten().to_numpy())
            ends = np.cumsum(np.concatenate([[0], held.value_lengths().to_numpy()]))
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])  # noqa: B023, E731
            cols = [total(times), total(times * best[place]), total(times * n[place])]
            out = [batch.column(0), batch.column(1), batch.column(2), batch.column(3), *map(pa.array, cols), batch.column(4), *batch.columns[7:]]
            yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in schema.split(", ")])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    schema += ", groups string" if with_groups else ""
    return rows.where("not partial").drop("partial").mapInArrow(run, schema), counts
