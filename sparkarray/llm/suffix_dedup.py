"""Exact substring removal: every byte of a string of ``LENGTH`` bytes that also starts elsewhere goes.

Repeats are found by merging Burrows-Wheeler transforms of shards: the shards' rows are interleaved and the interleave is
refined symbol by symbol, four at a step, through each shard's own transform and its last-to-first mapping; no suffix is
compared or sorted again. Rows that the same number of symbols leaves together are an interval of suffixes with that common
prefix; intervals of one row can't lead to a repeat and are left behind, and what is together after ``LENGTH`` symbols is
repeated.

What meets in a merge is decided by content, so that the merges are many and small:

1. Every window of ``LENGTH`` bytes is named by the least hash among its ``GRAM``-byte strings. Equal windows have equal
   names. Neighbouring windows with one name are a run, of ``SPAN`` windows at most; a text has a run for some 70 bytes.
2. A name that occurs once can't repeat. Where all runs of a name are equal texts, all their windows repeat. This leaves
   the runs at the borders of repeats: of these, one of each distinct text goes to the merge of its name's part.
3. A name with very many distinct runs is divided by where the name lies in a window, in steps, and by what all windows
   of such a step have in common; windows that differ there are not equal.

So no link between equal windows is lost, a common passage is a row for each distinct text around its borders, and no task
holds more than its share. Counts are partial aggregates; texts only move for documents that have repeats.

Edge cases: null text is empty; texts under ``LENGTH`` bytes stay whole; repeated rows count as different places, so both
lose all; overlapping and periodic strings count; an empty table gives no rows; further columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import col, table, written

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1  # strings of GRAM bytes in a window
#: Bytes hashed at once; bytes of a merge; shards of a merge; distinct runs of a name that divide it; step of a division.
CHUNK, MERGE_BYTES, SHARDS, MANY, STEP = 1_500_000, 2_000_000, 4, 4000, 16

_A = 0xD6E8FEB86659FD93
u64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u64(27))) * u64(0x94D049BB133111EB)
    return x ^ (x >> u64(31))


_BYTE = mix(np.arange(1, 257, dtype="u8") * u64(0x9E3779B97F4A7C15))


def hashes(b: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of the given lengths, by doubling; hash of length n at each start."""
    power = {1: _BYTE[b]}
    k = 1
    join = lambda x, y, n: x[: len(b) - n - (n_of[id(y)]) + 1] * u64(pow(_A, n_of[id(y)], 2**64)) + y[n : n + len(b) - n - n_of[id(y)] + 1]
    n_of = {id(power[1]): 1}
    while 2 * k <= max(lengths):
        power[2 * k] = join(power[k], power[k], k)
        n_of[id(power[2 * k])] = 2 * k
        k *= 2
    out = {}
    for n in lengths:
        h, have = None, 0
        for bit in sorted(power, reverse=True):
            if n - have >= bit:
                h = power[bit] if h is None else h[: len(b) - have - bit + 1] * u64(pow(_A, bit, 2**64)) + power[bit][have : have + len(b) - have - bit + 1]
                have += bit
        out[n] = h
    return out


def rolling(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over every n neighbours."""
    k = 1
    while 2 * k <= n:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def runs(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after the other (``ends``: where each ends) the runs: start, windows, name, hash of the run's text, tied."""
    empty = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "u8"), np.zeros(0, bool))
    if len(b) < LENGTH:
        return empty
    end = np.repeat(ends, np.diff(ends, prepend=0))
    h = hashes(b, (GRAM, LENGTH))
    g, whole = mix(h[GRAM]), h[LENGTH]
    v = rolling(g, SPAN, np.minimum)
    n = len(v)
    fits = np.arange(n) + LENGTH <= end[:n]
    new = np.ones(n, bool)
    new[1:] = (v[1:] != v[:-1]) | (end[1:n] != end[: n - 1]) | (fits[1:] != fits[:-1])
    # Periodic text keeps one name without end: cut, so that the first and the last window hold every byte.
    at = np.arange(n)
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % SPAN == 0
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    ok = fits[start]
    start, count = start[ok], count[ok]
    if not len(start):
        return empty
    name = v[start]
    last = start + count - 1
    text = mix(whole[start] * u64(3) + mix(whole[last] + count.astype("u8")))
    # A name that lies at two places near each other may repeat within its run.
    most = rolling(np.concatenate([np.zeros(SPAN - 1, "u8"), v, np.zeros(SPAN - 1, "u8")]), SPAN, np.maximum)
    place = np.flatnonzero(g == most[: len(g)])
    twice = (g[place][1:] == g[place][:-1]) & (np.diff(place) < SPAN)
    tied = np.isin(name, g[place][1:][twice]) if twice.any() else np.zeros(len(name), bool)
    return start, count, name, text, tied


SCANNED = "doc_id long, n_bytes long, sha string, text string, p binary, m binary, v binary, t binary, f binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ids: list, texts: list[str]) -> pa.RecordBatch:
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        long = [x for x in raw if len(x) >= LENGTH]
        ends = np.cumsum([len(x) for x in long]) if long else np.zeros(0, "i8")
        start, count, name, text, tied = runs(np.frombuffer(b"".join(long), "u1"), ends)
        of = np.searchsorted(ends, start, side="right")
        begin = (ends - [len(x) for x in long])[of] if long else start
        cut = np.searchsorted(of, np.arange(len(long) + 1))
        cols = [(start - begin).astype("i4"), count.astype("i4"), name, text, tied]
        parts: list[list[bytes]] = [[], [], [], [], []]
        k = 0
        for x in raw:
            here = slice(cut[k], cut[k + 1]) if len(x) >= LENGTH else slice(0, 0)
            k += len(x) >= LENGTH
            for p, c in zip(parts, cols):
                p.append(c[here].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(texts, pa.string()), *[pa.array(p, pa.binary()) for p in parts]],
            ["doc_id", "n_bytes", "sha", "text", "p", "m", "v", "t", "f"],
        )

    ids, texts, size = [], [], 0
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1)):
            x = x.as_py() or ""
            ids.append(i)
            texts.append(x)
            size += len(x)
            if size >= CHUNK:
                yield out(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield out(ids, texts)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid = b.column(0).to_numpy()
        n = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in b.column(1)], "i8")
        join = lambda c, t: np.frombuffer(b"".join(b.column(c).to_pylist()), t)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, n)), pa.array(i.astype("i4")), pa.array(join(1, "i8")), pa.array(join(2, "i8")), pa.array(join(3, "?"))], ["rid", "i", "v", "t", "f"])


# --- transforms of shards and their merge ---


def transform(text: np.ndarray, piece_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, transform and last-to-first mapping of a shard of pieces (``piece_end``: for each byte where its piece ends).

    Suffixes end with their piece and are told apart up to LENGTH bytes; by doubling of ranks.
    """
    n = len(text)
    left = piece_end - np.arange(n)
    # Seven bytes (zero beyond the end) and how many there are; then doubling.
    rank = np.zeros(n, "i8")
    for j in range(7):
        rank[: n - j] |= np.where(left[: n - j] > j, text[j:], 0).astype("i8") << (8 * (6 - j) + 3)
    rank |= np.minimum(left, 7)
    k = 7
    order = np.argsort(rank)
    while True:
        sorted_rank = rank[order]
        new = np.ones(n, "i8")
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        dense = np.cumsum(new)
        rank = np.empty(n, "i8")
        rank[order] = dense
        if k >= LENGTH or dense[-1] == n:
            break
        later = np.zeros(n, "i8")
        later[: n - k] = np.where(left[: n - k] > k, rank[k:], 0)
        rank = rank * (n + 1) + later
        order = np.argsort(rank)
        k *= 2
    row = np.empty(n, "i8")
    row[order] = np.arange(n)
    before = order - 1
    first = np.zeros(n, bool)
    first[0] = True
    first[1:] = piece_end[1:] != piece_end[:-1]
    has = ~first[order]
    bwt = np.where(has, text[before], 0).astype("u1")
    lf = np.where(has, row[before], -1)
    return order, bwt, lf


def merge_repeats(text: np.ndarray, piece_end: np.ndarray, starts: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Of the starts (each with LENGTH bytes in its piece) those whose string another one shares, and the number of the
    interval each is in.

    The refinement runs from the last symbols of the strings to the first, so at depth h the row of a start is that of the
    suffix LENGTH - h further on, and only these rows take part.
    """
    n = len(text)
    none = np.zeros(0, "i8"), np.zeros(0, "i8")
    if not len(starts):
        return none
    # Cut at borders of pieces into shards of about one size.
    borders = np.unique(piece_end)
    at = np.unique(np.concatenate([[0], borders[np.searchsorted(borders, np.linspace(0, n, shards + 1)[1:-1])], [n]]))
    suffix, symbol, last = [], [], []
    for lo, hi in zip(at, at[1:]):
        o, s, f = transform(text[lo:hi], piece_end[lo:hi] - lo)
        suffix.append(o + lo)
        symbol.append(s)
        last.append(np.where(f >= 0, f + lo, -1))
    order, bwt, lf = (np.concatenate(x) for x in (suffix, symbol, last))
    # Four symbols at a step: the transform and the mapping applied four times.
    one = lambda x, m: np.where(m >= 0, x[m], -1)
    lf2 = one(lf, lf)
    lf3 = one(lf, lf2)
    lf4 = one(lf2, lf2).astype("i4")
    near = bwt.astype("u2") + (np.where(lf >= 0, bwt[lf], 0).astype("u2") << 8)
    far = np.where(lf2 >= 0, bwt[lf2], 0).astype("u2") + (np.where(lf3 >= 0, bwt[lf3], 0).astype("u2") << 8)
    # Interleave of depth 0: shard after shard; depth 4: the rows in order of the strings' last four symbols.
    row_of = np.empty(n, "i4")
    row_of[order] = np.arange(n)
    now = row_of[starts + LENGTH - 4]
    words = np.zeros(n, "u4")
    words[: n - 3] = text[: n - 3].astype("u4") << 24 | text[1 : n - 2].astype("u4") << 16 | text[2 : n - 1].astype("u4") << 8 | text[3:].astype("u4")
    key = words[order[now]]
    o = np.argsort(key, kind="stable")
    now, key = now[o], key[o]
    block = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    depth = 4
    while depth < LENGTH and len(now):
        alone = np.bincount(block)[block] > 1
        now, block = now[alone], block[alone]
        if not len(now):
            break
        x = near[now]
        o = np.argsort(x, kind="stable")
        y = far[now[o]]
        o2 = np.argsort(y, kind="stable")
        o = o[o2]
        x, y, block = x[o], y[o2], block[o]
        now = lf4[now[o]]
        block = np.cumsum(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (block[1:] != block[:-1])])) - 1
        depth += 4
    alone = np.bincount(block)[block] > 1 if len(block) else np.zeros(0, bool)
    return order[now[alone]], block[alone]


PIECES = "part int, v long, t long, base int, m int, piece binary"


def _cut(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, v, t, base, m, piece = [], [], [], [], [], []
            for text, p, c, wanted in zip(*(b.column(k).to_pylist() for k in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                p, c = np.frombuffer(p, "i4"), np.frombuffer(c, "i4")
                for w in wanted:
                    s, k = int(p[w["i"]]), int(c[w["i"]])
                    own = raw[s : s + k + LENGTH - 1]
                    if not w["many"]:
                        part.append(w["v"] % n_parts)
                        v.append(w["v"]), t.append(w["t"]), base.append(0), m.append(k), piece.append(own)
                        continue
                    # Where the name lies in each window, leftmost; windows of one step share what lies between.
                    g = mix(hashes(np.frombuffer(own, "u1"), (GRAM,))[GRAM])
                    hit = np.flatnonzero(g == u64(w["v"] & 0xFFFFFFFFFFFFFFFF))
                    off = hit[np.searchsorted(hit, np.arange(k))] - np.arange(k)
                    cuts = np.flatnonzero(np.diff(off // STEP, prepend=-1) | (np.diff(off, prepend=off[0] + 1) != -1))
                    for lo, hi in zip(cuts, np.append(cuts[1:], k)):
                        a = lo + off[lo]  # the name's place; a window of the step begins at most q + STEP - 1 before it
                        q = int(off[lo] // STEP) * STEP
                        core = own[a - q : a - q - STEP + 1 + LENGTH]
                        part.append(int.from_bytes(hashlib.blake2b(core + bytes([q // STEP]), digest_size=7).digest(), "big") % n_parts)
                        v.append(w["v"]), t.append(w["t"]), base.append(int(lo)), m.append(int(hi - lo)), piece.append(own[lo : hi + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(v, pa.int64()), pa.array(t, pa.int64()), pa.array(base, pa.int32()), pa.array(m, pa.int32()), pa.array(piece, pa.binary())], ["part", "v", "t", "base", "m", "piece"])

    return run


def _merge(t: pa.Table) -> pa.Table:
    """(v, t, lo, hi): windows lo..hi-1 of a run that repeat."""
    pieces = t["piece"].to_pylist()
    base, m = t["base"].to_numpy().astype("i8"), t["m"].to_numpy().astype("i8")
    n = np.array([len(x) for x in pieces], "i8")
    ends = np.cumsum(n)
    # Only windows of a run are places of their own; what follows them belongs to other runs.
    begin = ends - n
    starts = np.repeat(begin, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    at, _ = merge_repeats(np.frombuffer(b"".join(pieces), "u1"), np.repeat(ends, n), starts)
    which = np.searchsorted(ends, at, side="right")
    off = at - begin[which]
    o = np.lexsort((off, which))
    which, off = which[o], off[o]
    first = np.ones(len(off), bool)
    first[1:] = (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1)
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(off)) - 1 if len(lo) else lo
    of = pa.array(which[lo])
    return pa.table({"v": t["v"].take(of), "t": t["t"].take(of), "lo": pa.array((base[which[lo]] + off[lo]).astype("i4")), "hi": pa.array((base[which[lo]] + off[hi] + 1).astype("i4"))})


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone, spans, sha = [], [], []
        for text, n, p, c, hits in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
            p = np.frombuffer(p, "i4").astype("i8")
            i = np.array([h["i"] for h in hits], "i8")
            whole = np.array([h["lo"] is None for h in hits], bool)
            lo = p[i] + np.array([h["lo"] or 0 for h in hits], "i8")
            hi = p[i] + np.where(whole, np.frombuffer(c, "i4")[i], np.array([h["hi"] or 0 for h in hits], "i8")) + LENGTH - 1
            step = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
            out = np.cumsum(step[:n]) > 0
            gone.append(int(out.sum()))
            spans.append(int((np.diff(out.astype("i1"), prepend=0) == 1).sum()))
            sha.append(hashlib.sha256(raw[~out].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    texts, _ = written(docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).mapInArrow(_scan, SCANNED).withColumn("rid", F.monotonically_increasing_id()), "suffix-texts")
    each = texts.select("rid", "v", "t", "f").mapInArrow(_explode, "rid long, i int, v long, t long, f boolean")
    names = each.groupBy("v").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"), F.bool_or("f").alias("f")).filter("n > 1 or f")
    names, _ = written(names.select("v", (F.col("f") | (F.col("a") != F.col("z"))).alias("mixed")), "suffix-names")
    found, _ = written(each.drop("f").join(names, "v"), "suffix-runs")
    # Runs of names with different texts: a text that occurs twice repeats whole; one of each text goes to the merge.
    distinct = found.filter("mixed").groupBy("v", "t").agg(F.count("*").alias("n"), F.min(F.struct("rid", "i")).alias("one"))
    distinct, _ = written(distinct, "suffix-distinct")
    many = distinct.groupBy("v").agg(F.count("*").alias("k")).filter(F.col("k") > MANY).select("v", F.lit(True).alias("many"))
    wanted = distinct.join(many, "v", "left").groupBy("one.rid").agg(F.collect_list(F.struct("one.i", "v", "t", F.coalesce("many", F.lit(False)).alias("many"))).alias("wanted"))
    wanted, _ = written(wanted, "suffix-wanted")
    n_parts = max(1, -(-distinct.count() * (LENGTH + 90) // MERGE_BYTES))
    pieces = texts.select("rid", "text", "p", "m").join(wanted, "rid").select("text", "p", "m", "wanted").mapInArrow(_cut(n_parts), PIECES)
    merged, _ = written(pieces.groupBy("part").applyInArrow(_merge, "v long, t long, lo int, hi int"), "suffix-merged")
    none = F.lit(None).cast("int")
    full = found.filter("not mixed").select("rid", "i", none.alias("lo"), none.alias("hi"))
    twice = found.filter("mixed").join(distinct.filter("n > 1").select("v", "t"), ["v", "t"]).select("rid", "i", none.alias("lo"), none.alias("hi"))
    part = distinct.filter("n = 1").join(merged, ["v", "t"]).select("one.rid", "one.i", "lo", "hi")
    hits = full.unionByName(twice).unionByName(part).groupBy("rid").agg(F.collect_list(F.struct("i", "lo", "hi")).alias("hits"))
    hits, _ = written(hits, "suffix-hits")
    with_hits = texts.join(hits, "rid").select("doc_id", "text", "n_bytes", "p", "m", "hits").mapInArrow(_remove, REMOVED)
    ids = hits.select("rid")
    rest = texts.select("rid", "doc_id", "n_bytes", "sha").join(ids, "rid", "left_anti")
    zero = F.lit(0).cast("long")
    return with_hits.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE: dict[str, str] = {}
