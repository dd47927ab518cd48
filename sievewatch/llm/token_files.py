"""Token ids as ORC files in id order, read back by stripe.

Rows are dealt out by ranges of the id, so files and the rows in them ascend. Each file holds the id, the number of its
shard, the row's first position in the file's stream of ids, and the ids as integers, which ORC run-length encodes by
stripe. Row indexes (one entry per INDEX_STRIDE rows) and Bloom filters on the id let a reader skip stripes and row
groups for a lookup; stripes are read in parallel. Where a file's stream begins in the whole one follows from one total
per file.

Ids come from the tokenizers library. White space never joins tokens in the tokenizer used, so a text is encoded by
its chunks between ASCII white space, each chunk once as long as the worker remembers it. Where the tokenizer lowers case
and marks word ends, chunks are looked up in lower case, a word and the comma or full stop behind it apart, and new
words go to the library many in a text, whose ids are cut at the word ends. ``chunked=False`` encodes whole texts, for
tokenizers that keep white space.

Defined cases: a null or empty text is the end id alone; null ids come first, rows with equal ids are put in order of
their text hash; repeated rows are written each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import array
import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewatch.llm.common import lean, stage, text_batches, text_of, work_path, worker_store

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Chunks kept by a worker: so many that came lately, and as many that came before those.
REMEMBERED = 400_000
#: New words in one text.
TOGETHER = 64
GROUP = 4 << 20
INDEX_STRIDE = 10_000
STRIPE_BYTES = 64 << 20
BLOOM_FALSE_POSITIVES = 0.01


def _plain(text: str) -> bool:
    """Letters that stay single letters in lower case and in composed form."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0130")


class LibraryEncoder:
    """Texts to ids (little-endian unsigned 32-bit) by the tokenizers library."""

    def __init__(self, spec: str, store: dict, chunked: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.store = store
        self.chunks: dict[str, bytes] = store.setdefault("chunks", {})
        self.chunked = chunked
        read = json.loads(spec)
        suffix = read["model"].get("end_of_word_suffix")
        # with all three, letters between other characters are one word of their own, whatever their case
        lowers = '"Lowercase"' in json.dumps(read.get("normalizer"))
        splits = [x.get("pattern", {}).get("Regex", "") for x in (read.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.words = bool(suffix) and lowers and any(r"[\p{L}]+" in x for x in splits)
        if self.words:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in read["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh_words(self, words: list[str]) -> list[bytes]:
        joined = [" ".join(words[at: at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        flat = b"".join(self._fresh(joined))
        cuts = ((np.nonzero(self.ends[np.frombuffer(flat, "<u4")])[0] + 1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if words else []

    def _split(self, texts: list[str]) -> pa.ListArray:
        whole = pa.array(texts, pa.large_string())
        if self.words:  # special tokens have a case of their own, and combining marks compose with some letters of one case only
            odd = pc.or_(pc.match_substring(whole, "<|"), pc.match_substring_regex(whole, r"[^\x{0}-\x{2FF}]"))
            whole = pc.if_else(odd, whole, pc.ascii_lower(whole))
        return pc.ascii_split_whitespace(whole)

    def _learn(self, new: list[str]) -> None:
        if not self.words:
            self.chunks.update(zip(new, self._fresh(new), strict=True))
            return
        words, marked, rest = {}, [], [",", "."]
        for chunk in new:
            if _plain(chunk):
                words[chunk] = None
            elif chunk[-1:] in (",", ".") and _plain(chunk[:-1]):
                marked.append(chunk)
                words[chunk[:-1]] = None
            else:
                rest.append(chunk)
        fresh = [c for c in words if c not in self.chunks]
        self.chunks.update(zip(fresh, self._fresh_words(fresh), strict=True))
        self.chunks.update(zip(rest, self._fresh(rest), strict=True))
        for chunk in marked:
            self.chunks[chunk] = self.chunks[chunk[:-1]] + self.chunks[chunk[-1]]

    def _known(self, chunks: list[str]) -> list[bytes]:
        if len(self.chunks) > REMEMBERED:
            self.store["before"], self.chunks = self.chunks, {}
            self.store["chunks"] = self.chunks
        new = [c for c in chunks if c not in self.chunks]
        before = self.store.get("before", {})
        self.chunks.update((c, before[c]) for c in new if c in before)
        new = [c for c in new if c not in before]
        if new:
            self._learn(new)
        return [self.chunks[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return self._fresh(texts)
        split = self._split(texts)
        coded = split.values.dictionary_encode()
        ids = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        each = sizes[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = table[np.repeat(at[which] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _writer(spec, name: str, chunked: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder(spec.value, worker_store(f"library-{name}"), chunked)
        shard, position = TaskContext.get().partitionId(), 0
        end = END_ID.to_bytes(4, "little")

        def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            nonlocal position
            made = [x + end for x in encoder.encode(texts)]
            sizes = np.fromiter((len(x) // 4 for x in made), np.int64, len(made))
            starts = position + np.cumsum(sizes) - sizes
            position += int(sizes.sum())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.frombuffer(b"".join(made), "<u4").astype(np.int32)
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(made), shard, np.int32)), pa.array(starts), pa.ListArray.from_arrays(offsets, flat)], names=["id", "shard", "first", "ids"])

        for batch in batches:
            at, size, held = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= GROUP:
                    yield rows(batch.column(0).slice(at, k + 1 - at), held)
                    at, size, held = k + 1, 0, []
            if held:
                yield rows(batch.column(0).slice(at), held)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunked: bool = True) -> None:
    """Write ORC files (id, shard, first, ids) below ``path``, ascending in the id."""
    text_batches(docs.sparkSession)
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer's file, a few MB
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    slim = slim.withColumn("text_hash", F.xxhash64("text"))
    placed = slim.repartitionByRange("id", "text_hash").sortWithinPartitions("id", "text_hash").select("id", "text")
    rows = placed.mapInArrow(lean(_writer(spec, tokenizer, chunked)), "id long, shard int, first long, ids array<int>")
    (
        rows.write.option("orc.row.index.stride", INDEX_STRIDE).option("orc.stripe.size", STRIPE_BYTES).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "id").option("orc.bloom.filter.fpp", BLOOM_FALSE_POSITIVES).option("compression", "zstd").orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids): ``start`` counts all ids before the row's."""
    files = spark.read.schema("id long, shard int, first long, ids array<int>").orc(path)
    totals = files.groupBy("shard").agg(F.sum(F.size("ids")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = stage(totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "file-starts")
    return files.join(bases, "shard").select("id", (F.col("base") + F.col("first")).alias("start"), "ids")


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        flat, cuts = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def token_file_report(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder, read them back: (id, start, n_tokens, ids_crc32) of each row."""
    path = work_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, id_col, text_col)
    read = read_token_files(docs.sparkSession, path)
    return read.mapInArrow(lean(_checksums), "id long, start long, n_tokens long, ids_crc32 long")
