"""Packing by concatenate and cut.

All documents, each followed by an end id, form one stream in partition order. Pass one encodes every text once and writes
``(part, start in part, ids)`` to the shared folder; the partitions' token totals, summed up, give each partition its
offset in the stream. Pass two cuts the stream at fixed windows: a row's global offset is its partition's offset plus its
own, so every window and every cut follows from two integers and no document moves between machines. Where the sequences
themselves are wanted (``pack_sequences``), a task strings together what follows without a gap; a window that lies whole in
its rows is done there, and only the two cut ones at the ends of a run of rows are boundary records, which meet by window.

The encoding takes words apart before the tokenizer sees them. That is right for tokenizers that part letters from all else,
lower them and drop white space; any other is found out by probes and given whole texts (``takes_pieces``).

Edge cases: a null text is empty and gives the end id alone; a null doc_id stays null; repeated rows are packed each; an
empty table gives no sequences; long texts are cut over as many windows as they need; further columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import col, table, written

WINDOW, END_ID = 2048, 1
#: Words a worker keeps with their ids; when full it starts anew. Documents whose words are told apart at once.
CACHE_WORDS, CACHE_LEN, AT_ONCE = 250_000, 48, 1000

_known: dict[str, tuple] = {}
#: Texts on which the ids of pieces have to be those of the whole; a tokenizer that departs is given whole texts.
PROBES = ("Plain words, and MORE Words.", "It's (so-called) \"quoted\"...", "a1b2 3,141.59 x_y", "  two  blanks\n\nand\tlines ", "Éàß Straße naïve", "don't won't", "http://a.b/c?d=e&f", "ENDING!? word;word", "\u4e2d\u6587 caf\u00e9\u0301", "[UNK] <s> </s>", "x" * 60)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _encoder(path: str):
    """The tokenizer, its bare model and a store of words with their ids, kept while the worker lives."""
    if path not in _known:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _known[path] = (tok, Tokenizer(tok.model), {})
    return _known[path]


def takes_pieces(path: str) -> bool:
    """Whether this tokenizer gives a text the ids of its pieces, one after the other."""
    key = f"{path}\0pieces"
    if key not in _known:
        tok = _encoder(path)[0]
        try:
            ok = all(np.frombuffer(x, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids for t, x in zip(PROBES, _by_pieces(path, pa.array(PROBES))))
        except Exception:  # noqa: BLE001  a model that can't take bare letters
            ok = False
        _known[key] = (ok,)
        _encoder(path)[2].clear()
    return _known[key][0]


#: Latin letters that neither compose nor lower in more than one way, and the punctuation that may follow them.
PLAIN = "^(?P<body>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<tail>[!-/:-@\\[-`{-~]*)$"


def _looked_up(words: pa.Array, encode, store: dict[str, bytes]) -> pa.Array:
    """Ids of words, each distinct one looked up or encoded once."""
    enc = words.dictionary_encode()
    names = enc.dictionary.to_numpy(zero_copy_only=False)
    got = list(map(store.get, names))
    new = [i for i, x in enumerate(got) if x is None]
    if len(store) + len(new) > CACHE_WORDS:
        store.clear()
    for k in range(0, len(new), 4000):
        part = new[k : k + 4000]
        for i, e in zip(part, encode([names[i] for i in part])):
            got[i] = np.array(e.ids, "<u4").tobytes()
            if len(names[i]) <= CACHE_LEN:
                store[names[i]] = got[i]
    return pa.array(got, pa.large_binary()).take(enc.indices)


def encode_pieces(path: str, pieces: pa.Array) -> pa.Array:
    """Ids, as little-endian unsigned 32-bit, of pieces without blanks.

    A piece of letters with punctuation behind it is two: this kind of tokenizer parts letters from all else, lowers them,
    and runs its merges over either alone. Letters go to the bare model; whatever is less plain to the whole tokenizer.
    """
    tok, bare, store = _encoder(path)
    match = pc.extract_regex(pieces, PLAIN)
    plain = match.is_valid()
    letters = lambda ws: bare.encode_batch_fast([w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in ws], add_special_tokens=False)
    rest = lambda ws: tok.encode_batch_fast(ws, add_special_tokens=False)
    match = match.filter(plain)
    body = _looked_up(pc.utf8_lower(match.field("body")), letters, store)
    tail = _looked_up(match.field("tail"), rest, store)
    whole = _looked_up(pieces.filter(pc.invert(plain)), rest, store)
    both = pa.concat_arrays([pc.binary_join_element_wise(body, tail, pa.scalar(b"", pa.large_binary())), whole])
    at = np.empty(len(pieces), "i8")
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))])
    at[order] = np.arange(len(order))
    return both.take(pa.array(at))


def _by_pieces(path: str, part: pa.Array, end: bytes = b"") -> Iterator[bytes]:
    """Each distinct piece of a batch is looked up or encoded once, and Arrow strings the ids together."""
    part = pc.split_pattern(pc.replace_substring(pc.fill_null(part, ""), "\n", " "), " ")
    pieces = part.flatten().dictionary_encode()
    ids = encode_pieces(path, pieces.dictionary).take(pieces.indices)
    data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else memoryview(b"")
    ends = np.frombuffer(ids.buffers()[1], "i8", len(ids) + 1, ids.offset * 8) if len(ids) else np.zeros(1, "i8")
    cuts = ends[part.offsets.to_numpy() - part.offsets[0].as_py()].tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        yield b"".join((data[lo:hi], end))


def encode_texts(path: str, texts: pa.Array, end: bytes = b"") -> Iterator[bytes]:
    """Ids of each text as bytes (null: none), ``end`` behind."""
    whole = not takes_pieces(path)
    for at in range(0, len(texts), AT_ONCE):
        part = texts.slice(at, AT_ONCE)
        if whole:
            for e in _encoder(path)[0].encode_batch_fast(pc.fill_null(part, "").to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes() + end
        else:
            yield from _by_pieces(path, part, end)


ENCODED = "part int, start_in_part long, doc_id long, n int, ids binary"


def _encode(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for some in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            ids = list(encode_texts(path, some.column(1), end))
            n = np.array([len(x) // 4 for x in ids], "i8")
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, "i4")), pa.array(start), some.column(0).cast(pa.int64()), pa.array(n.astype("i4")), pa.array(ids, pa.binary())],
                ["part", "start_in_part", "doc_id", "n", "ids"],
            )

    return run


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass one: every document's ids with its place in its partition, as a written table, and the offsets of partitions."""
    path = tokenizer or default_tokenizer()
    out, _ = written(docs.select(col("doc_id"), col("text")).mapInArrow(_encode(path, end_id), ENCODED), "packing-ids")
    # One row for each partition of the first pass, whatever the number of documents.
    totals = out.groupBy("part").agg(F.sum("n").alias("tokens"))
    offsets = sorted((r.part, r.tokens) for r in totals.collect())
    before, rows = 0, []
    for part, tokens in offsets:
        rows.append((part, before))
        before += tokens
    spark = docs.sparkSession
    return out.join(F.broadcast(spark.createDataFrame(rows, "part int, before long")), "part").withColumn("at", F.col("before") + F.col("start_in_part"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, n, at = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            ids = b.column(3)
            if not len(n):
                continue
            first, last = at // window, (at + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            lo = np.maximum(seq * window, at[row])
            hi = np.minimum((seq + 1) * window, (at + n)[row])
            start = lo - at[row]
            length = hi - lo
            buffers = [memoryview(x.as_buffer()) for x in ids]
            pieces = [buffers[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
            crc = pa.array([zlib.crc32(p) for p in pieces], pa.int64())
            arrays = [doc.take(pa.array(row)), pa.array(start), pa.array(length), crc, pa.array(n[row].astype("i8")), pa.array(seq), pa.array(lo - seq * window)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass two: one row for each piece of a document in a window; all windows are full but the last."""
    rows = encoded(docs, tokenizer, end_id).select("doc_id", "n", "at", "ids")
    return rows.mapInArrow(_cut(window), PIECES)


STRUNG = "sequence_id long, offset long, n_tokens int, ids binary, doc_starts array<long>"


def _string(window: int):
    """Rows (at, n, ids) in order: the windows they fill, and boundary records of those they fill in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []  # of the window at hand: bytes, and where documents start in it
        starts: list[int] = []
        begin = end = None  # places of the window at hand in the stream
        done: list[tuple] = []

        def close() -> None:
            nonlocal begin
            if parts:
                done.append((begin // window, begin % window, end - begin, b"".join(parts), starts.copy()))
            parts.clear()
            starts.clear()
            begin = end

        def out() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[]] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], ["sequence_id", "offset", "n_tokens", "ids", "doc_starts"])

        for b in batches:
            for at, n, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                if at != end:
                    close()
                    begin = end = at
                data, lo = memoryview(ids), 0
                while lo < n:
                    take = min(n - lo, window - end % window)
                    starts.append(end % window)
                    parts.append(data[4 * lo : 4 * (lo + take)])
                    lo, end = lo + take, end + take
                    if end % window == 0:
                        close()
            yield out()
        close()
        yield out()

    return run


def pack_sequences(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, input_ids, doc_starts (offsets at which a document's piece begins).

    Rows come in the order of the stream within a task's share of a file; only windows that such a share cuts are shuffled,
    and each is one window of ``window`` ids at most, so no key grows.
    """
    rows = encoded(docs, tokenizer, end_id).select("at", "n", "ids")
    strung, _ = written(rows.mapInArrow(_string(window), STRUNG), "packing-windows")
    cut = strung.filter(F.col("n_tokens") < window).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "n_tokens", "ids", "doc_starts"))).alias("p"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype("i4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())), b.column(2)], ["sequence_id", "n_tokens", "input_ids", "doc_starts"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = b.column(1).to_pylist()
            ids = [b"".join(x["ids"] for x in p) for p in records]
            yield from whole(iter([pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([[s for x in p for s in x["doc_starts"]] for p in records], pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_starts"])]))

    schema = "sequence_id long, n_tokens int, input_ids array<int>, doc_starts array<long>"
    full = strung.filter(F.col("n_tokens") == window).select("sequence_id", "ids", "doc_starts")
    return full.mapInArrow(whole, schema).unionByName(cut.mapInArrow(joined, schema))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
