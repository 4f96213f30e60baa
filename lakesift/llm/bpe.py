"""BPE encoding and decoding over a table of distinct words.

The tokenizer drops white space and no token spans it, so a text's ids are the ids
of its white-space-separated words, one after the other. The steps:

1. Each task splits the texts of its rows into words, numbers the distinct words of a
   block of up to `block_bytes` of text, and packs the block: its distinct words, and
   every text as the numbers of its words in order (the positions).
2. The blocks' distinct words are dealt out by hash of the word, so equal words of all
   blocks meet in one task, which encodes each distinct word once.
3. The ids come back to each block by a join on the block. A block's distinct words are decoded there by `piece_rows`, a hash join
   of their ids with the table of ids and pieces; `decode` runs the same join over any table of ids. Ids and pieces are then joined to
   positions by the word's number.

A block's number is a hash of what it holds, so a task that runs again finds the same one, and two blocks that share it are alike.

A word reaches the shuffle once a block, however often it stands there, so a frequent word makes no
large group. Texts are shuffled once, packed; both of their uses read that one exchange.
Memory is bounded by a block, and by the distinct words of a partition; the number of partitions is
spark.sql.shuffle.partitions. The tokenizer's file (a fixed few MB) is broadcast.

Defined cases: a null text is empty; a text without words has no ids and an empty decoded text; equal
rows are each given; a text longer than a block is a block of its own; an empty
table gives an empty result; columns other than the id and the text aren't looked at.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lakesift.llm.common import shuffle_partitions, table

TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 24 << 20
AT_ONCE = 20_000
PACKED = "block long, rows binary, positions binary, words binary"
LISTS = "block long, numbers binary, sizes binary, ids binary"


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """uint32 numbers, byte by byte, so that the rare high bytes compress to nearly nothing."""
    return _press(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    flat = np.frombuffer(_open(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").ravel()


class _Numbered(dict):
    """Numbers each key when it is first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _packed_block(ids: list, sizes: list[int], positions: array, words: _Numbered) -> pa.RecordBatch:
    """One row. Words are numbered anew, the most frequent first, so that the numbers compress well and don't hang on the order of rows."""
    at, listed = np.frombuffer(positions, np.uint32), list(words)
    counts = np.bincount(at, minlength=len(listed))
    order = sorted(range(len(listed)), key=lambda k: (-counts[k], listed[k]))
    place = np.empty(len(listed), np.uint32)
    place[order] = np.arange(len(listed), dtype=np.uint32)
    rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    cells = [sink.getvalue().to_pybytes(), _planes(place[at]), _press(b"\n".join(listed[k] for k in order))]
    cells.insert(0, int.from_bytes(hashlib.md5(b"".join(cells)).digest()[:8], "big", signed=True))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, [pa.int64(), *[pa.binary()] * 3])], names=["block", "rows", "positions", "words"])


def _pack(block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, positions, ids, sizes, held = _Numbered(), array("I"), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if held and held + len(text) > block_bytes:
                    yield _packed_block(ids, sizes, positions, words)
                    words, positions, ids, sizes, held = _Numbered(), array("I"), [], [], 0
                found = text.split()  # the white space of bytes: U+0009 to U+000D and U+0020
                positions.extend(map(words.__getitem__, found))
                ids.append(key)
                sizes.append(len(found))
                held += len(text)
        if ids:
            yield _packed_block(ids, sizes, positions, words)

    return pack


def _scatter(parts: int):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(3)):
                words = _open(packed.as_py()).split()
                part = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % parts
                order = np.argsort(part, kind="stable")
                starts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(k, block, order[a:b]) for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])) if a < b]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _, _ in rows], pa.int32()),
                            pa.array([b for _, b, _ in rows], pa.int64()),
                            pa.array([_planes(x) for *_, x in rows], pa.binary()),
                            pa.array([_press(b"\n".join([words[i] for i in x])) for *_, x in rows], pa.binary()),
                        ],
                        names=["part", "block", "numbers", "words"],
                    )

    return scatter


def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(content)
    made.no_truncation()
    made.no_padding()
    return made


def _encode(sent):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses = _Numbered(), []
        for batch in batches:
            for block, numbers, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = _open(words).split()
                uses.append((block, numbers, np.fromiter(map(known.__getitem__, found), np.int64, len(found))))
        if not uses:
            return
        tokenizer, distinct = _tokenizer(sent.value), [w.decode() for w in known]
        del known
        sizes, flat = np.zeros(len(distinct), np.int64), array("I")
        for at in range(0, len(distinct), AT_ONCE):
            for k, got in enumerate(tokenizer.encode_batch_fast(distinct[at : at + AT_ONCE], add_special_tokens=False), at):
                sizes[k] = len(got.ids)
                flat.extend(got.ids)
        ends, ids = np.cumsum(sizes), np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32)
        for block, numbers, which in uses:
            n = sizes[which]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            taken = ids[np.repeat(ends[which] - n, n) + inside]
            cells = [block, numbers, _planes(n), _planes(taken)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, [pa.int64(), *[pa.binary()] * 3])], names=["block", "numbers", "sizes", "ids"])

    return encode


def _joined(sent, full: bool):
    """Joins the words' ids to the positions of the texts of a block."""

    def join(packed: pa.Table, lists: pa.Table) -> pa.Table:
        pieces = _pieces(sent.value)
        digits = [str(k) for k in range(pieces.num_rows)]
        out = []
        names = pieces.column("piece").to_pylist()
        for rows, positions, words in zip(*(packed.column(c).to_pylist() for c in ("rows", "positions", "words"))):
            count = len(_open(words).split())
            sizes = np.full(count, -1, np.int64)
            as_ids, as_text = [""] * count, [""] * count
            for cells in zip(*(lists.column(c) for c in ("numbers", "sizes", "ids"))):  # a part of the words at a time
                numbers, lengths, word_ids = (_numbers(x.as_py()) for x in cells)
                sizes[numbers] = lengths
                said, at = piece_rows(word_ids, pieces).tolist(), 0
                word_ids = word_ids.tolist()
                for number, size in zip(numbers.tolist(), lengths.tolist()):
                    end = at + size
                    as_ids[number] = " ".join([digits[k] for k in word_ids[at:end]])
                    as_text[number] = " ".join([names[k] for k in said[at:end]])
                    at = end
            if (sizes < 0).any():
                raise ValueError("a word of a block has no ids")
            listed, positions = pa.ipc.open_stream(rows).read_all(), _numbers(positions)
            tokens, hashes, texts, ids_out, decoded_out, at = [], [], [], [], [], 0
            for n in listed.column("n").to_pylist():
                mine = positions[at : at + n]
                at += n
                per_word = sizes[mine]
                tokens.append(int(per_word.sum()))
                mine = mine[per_word > 0].tolist()
                ids, decoded = " ".join(map(as_ids.__getitem__, mine)), " ".join(map(as_text.__getitem__, mine))
                hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    ids_out.append([int(x) for x in ids.split()])
                    decoded_out.append(decoded)
            columns = {"doc_id": listed.column("id"), "n_tokens": pa.array(tokens, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            if full:
                columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(decoded_out, pa.string())}
            out.append(pa.table(columns))
        return pa.concat_tables(out) if out else pa.table({})

    return join


def _pieces(content: str) -> pa.Table:
    """(token, piece) of each id of the vocabulary, a fixed table."""
    tokenizer = _tokenizer(content)
    n = tokenizer.get_vocab_size(with_added_tokens=True)
    return pa.table({"token": pa.array(range(n), pa.int32()), "piece": pa.array([tokenizer.id_to_token(k) or "" for k in range(n)], pa.string())})


def piece_rows(ids: np.ndarray, pieces: pa.Table) -> np.ndarray:
    """The row of the table of pieces that each id joins, -1 for ids that the vocabulary hasn't: its tokens are hashed once, and each id looks itself up there."""
    return pc.index_in(pa.array(ids.astype(np.int64)), value_set=pieces.column("token").combine_chunks().cast(pa.int64())).fill_null(-1).to_numpy()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, full: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with full the ids and the decoded text themselves."""
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        content = file.read()
    made = _tokenizer(content)
    if made.decoder is not None or made.post_processor is not None:
        raise ValueError("word by word encoding is for tokenizers that drop white space and have neither post-processor nor decoder")
    sent, parts = spark.sparkContext.broadcast(content), shuffle_partitions(spark)
    packed = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_pack(block_bytes), PACKED).repartition(parts, "block")
    words = packed.mapInArrow(_scatter(parts), "part int, block long, numbers binary, words binary").repartition(parts, "part")
    lists = words.mapInArrow(_encode(sent), LISTS)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return packed.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(_joined(sent, full), schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, decoded): the pieces of each row's ids, by the join with the table of pieces, joined by one space.

    Null or no ids give an empty text, ids that the vocabulary hasn't are left out; no shuffle.
    """
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(sent.value)
        names = pieces.column("piece").to_pylist()
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            ids = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
            found, at, out = piece_rows(ids, pieces).tolist(), 0, []
            for n in sizes.tolist():
                out.append(" ".join([names[k] for k in found[at : at + n] if k >= 0]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    key = encoded.schema[id_col].dataType.simpleString()
    return encoded.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(run, f"doc_id {key}, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
