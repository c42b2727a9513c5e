"""Vector bin packing of tokenised examples into training sequences.

Examples have a demand on three limits: tokens, segments and loss-bearing tokens. A sequence is filled by the dot-product
heuristic: of the examples that still fit all limits, the one whose weighted demand has the largest dot product
with what is left of the sequence comes next. Examples longer than a sequence are cut into full sequences
and a rest. Pieces are dealt by a hash of (document, start, ids) into groups of bounded size and each group is packed by
itself; the number of groups follows the input, and each leaves at most a few sequences underfilled.

Edge cases: null and empty texts have the end id only; a null id stays null; repeated rows are packed as documents of their own; ties go to
the smaller (doc_id, start); an example that alone exceeds a limit other than tokens gets a sequence for itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._words import releasing

SEQUENCE, SEGMENTS, END_ID = 2048, 256, 1
GROUP_ROWS = 8192
#: Characters outside of old, settled blocks (Latin, Greek, Cyrillic, punctuation, kana, common ideographs). Libraries may know them by
#: different editions of Unicode, so texts with them are cut into tokens by the tokenizer itself.
_UNSETTLED = re.compile(r"[^\x00-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u045f\u2000-\u2063\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
_loaded: dict = {}


def _encoders(path: str, ranks_path: str | None) -> tuple:
    """The tokenizer of a file, and a faster encoder over the same vocabulary if its ranks are given."""
    if (path, ranks_path) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, quick = Tokenizer.from_file(path), None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _loaded[path, ranks_path] = tokenizer, quick
    return _loaded[path, ranks_path]


def token_bytes(texts: list[str | None], path: str, ranks_path: str | None = None) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit values, one text at a time."""
    tokenizer, quick = _encoders(path, ranks_path)
    for text in texts:
        if not text:
            yield b""
        elif quick is None or not text.isascii() and _UNSETTLED.search(text):
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            yield quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut into full sequences and a rest."""
    ship(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                for doc, ids in zip(part.column(0).to_pylist(), token_bytes(part.column(1).to_pylist(), tokenizer_path, ranks_path), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        piece = ids[4 * start : 4 * (start + sequence)]
                        out.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(releasing(step), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item; demands: items x limits, tokens first, in the order that breaks ties.

    Equal demands are one class with a stack of items, so a step looks at classes and not at items.
    """
    n = len(demands)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, offset
    kinds, kind = np.unique(demands, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=len(kinds)))
    heads = ends - np.bincount(kind, minlength=len(kinds))
    share = kinds / limits
    weight = np.maximum((demands / limits).mean(axis=0), 1e-9)
    alive = np.ones(len(kinds), bool)
    left, current, used = n, -1, 0
    room = np.zeros(len(limits))
    while left:
        fits = alive & (kinds <= room).all(axis=1)
        if current < 0 or not fits.any():
            current, used, room = current + 1, 0, limits.astype(float).copy()
            fits = alive & (kinds <= room).all(axis=1)
            if not fits.any():
                fits = alive
        score = np.where(fits, share @ (weight * np.maximum(room, 0) / limits), -1.0)
        best = int(np.argmax(score))
        copies = 1
        item = order[heads[best] : heads[best] + copies]
        sequence[item], offset[item] = current, used
        used += int(kinds[best, 0])
        room = room - kinds[best]
        heads[best] += copies
        alive[best] = heads[best] < ends[best]
        left -= copies
    return sequence, offset


def pack_pieces(rows: DataFrame, n_rows: int, sequence: int = SEQUENCE, segments: int = SEGMENTS, loss_limit: int | None = None) -> DataFrame:
    """Adds sequence_id, offset and padded. A column `loss` has loss-bearing tokens; without it, all tokens bear loss.

    n_rows: how many rows there are at most; it sets the number of groups, each of about GROUP_ROWS rows or fewer.
    """
    ship(rows.sparkSession)
    limits = np.array([sequence, segments, loss_limit or sequence])
    groups = max(1, -(-n_rows // GROUP_ROWS))
    names = [c for c in rows.columns if c != "loss"]
    loss = F.col("loss") if "loss" in rows.columns else F.col("length")

    def step(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        table = table.take(order)
        lengths = table.column("length").to_numpy()
        ids, offset = pack(np.column_stack([lengths, np.ones(len(lengths), np.int64), table.column("_loss").to_numpy()]), limits)
        total = np.bincount(ids, weights=lengths).astype(np.int64)
        whole = np.where((total & (total - 1)) == 0, total, sequence)
        added = [(int(key[0].as_py()) << 32) + ids, offset, (whole - total)[ids]]
        return pa.table([*(table.column(n) for n in names), *(pa.array(v, pa.int64()) for v in added)], names=[*names, "sequence_id", "offset", "padded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "loss") + ", sequence_id long, offset long, padded long"
    told = [c for c in ("doc_id", "start", "ids_crc32") if c in names]
    dealt = rows.withColumn("_loss", loss.cast("long")).withColumn("_group", F.pmod(F.xxhash64(*told), F.lit(groups)))
    return dealt.select(*names, "_loss", "_group").groupBy("_group").applyInArrow(step, schema)


def tokenizer_files() -> tuple[str, str]:
    """A byte-level vocabulary as a tokenizer and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece of every document, with its place in a sequence."""
    files = (tokenizer_path,) if tokenizer_path else tokenizer_files()
    # a token has a byte at least, so there are no more pieces than this
    most = docs.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.floor(F.octet_length("text") / SEQUENCE)), F.lit(0))).first()[0]
    return pack_pieces(pieces(docs, *files), most)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
