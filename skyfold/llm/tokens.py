"""Token-id output: documents in id order, encoded and written as seekable files, one per range of ids.

Documents are range-partitioned by id, so files follow each other in id order. Each task encodes its
documents and streams them into one file in the shared folder under a name of its own, then renames it, so a task that runs again
replaces what it wrote before. The manifest (one row per file) is a table beside the files. Reading deals the
files out to tasks again.

Encoding is the tokenizer's own, with one saving: text never joins over white space in this kind of vocabulary (white space is
dropped), so each distinct word is encoded once per worker and kept. Its normaliser, splitter and merges are the library's. Words that
hold a special token or rarer white space are encoded whole. If the normaliser lower-cases, ASCII letters are lower-cased before the store is asked, in texts
without combining marks (some compose with small letters only).

Defined cases: a null or empty text is the end id alone; null ids come first; rows of equal id are ordered by a hash of
their text; an empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import json
import re
import string
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.llm.common import lean, ship, whole_text
from skyfold.llm.seekable import Reader, Writer, open_fs
from skyfold.session import scratch_path, shuffle_width

END_ID = 2
#: Most words and word pieces a worker keeps encoded; beyond that it starts anew.
KEPT_WORDS = 300_000
#: Letters below this are known as such to every version of Unicode in use; a run of these marks after letters is one piece.
_LATIN_END, _MARKS = "\u0250", string.punctuation.replace("'", "")
#: First bytes of the combining marks U+0300 to U+036F in UTF-8 (and of some letters beside them).
_COMBINING = re.compile(rb"[\xcc\xcd]")


def _raw(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class WordEncoder:
    """Encodes whole texts through a bounded store of encoded words."""

    def __init__(self, file: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.kept = kept
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.letters: dict[str, str] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.special = [t["content"] for t in spec["added_tokens"]]
        norm = spec["normalizer"] or {}
        self.lowers = any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm]) if n)

    def _ids(self, text: str) -> bytes:
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letter(self, c: str) -> str:
        """A letter as the splitter writes its bytes."""
        self.letters[c] = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
        return self.letters[c]

    def _learn(self, fresh: list[bytes]) -> None:
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        if len(self.marks) > self.kept:
            self.marks = {"": b""}
        words, pieces, letters = self.words, self.pieces, self.letters
        joined = b"\n".join(fresh).decode()
        if any(x in joined for x in self.special) or len(joined.split()) != len(fresh):
            odd = {w for w in fresh if (s := w.decode()).split() != [s] or any(x in s for x in self.special)}
            words.update((w, self._ids(w.decode())) for w in odd)
            fresh = [w for w in fresh if w not in odd]
            joined = b"\n".join(fresh).decode()
        # All plain words go through the normaliser at once; pieces never cross a blank.
        parts = self.tokenizer.normalizer.normalize_str(joined).split(" ")
        if len(parts) != len(fresh):  # a character that became white space by normalising
            words.update((w, self._ids(w.decode())) for w in fresh)
            return
        split, merge = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        for part, w in zip(parts, fresh, strict=True):
            body = part.rstrip(_MARKS)
            ids = pieces.get(body)
            if ids is None:
                if body.isascii():
                    name = body if body.isalpha() else None
                elif body.isalpha() and max(body) < _LATIN_END:  # one run of letters
                    name = "".join([letters.get(c) or self._letter(c) for c in body])
                else:
                    name = None
                if name is None:
                    words[w] = _raw([t.id for p, _ in split(part) for t in merge(p)])
                    continue
                ids = pieces[body] = _raw([t.id for t in merge(name)])
            if len(body) < len(part):
                mark = part[len(body) :]
                if mark not in self.marks:
                    self.marks[mark] = self._ids(mark)
                ids += self.marks[mark]
            words[w] = ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as raw little-endian bytes, without an end id."""
        out, words = [], self.words
        for text in texts:
            split = self._folded(text).split()
            fresh = set(split).difference(words)
            if len(fresh) > self.kept // 4:  # one giant text: no use in keeping its words
                out.append(self._ids(text.decode()))
                continue
            if len(words) + len(fresh) > self.kept:
                words.clear()
                fresh = set(split)
            if fresh:
                self._learn(list(fresh))
            out.append(b"".join(map(words.__getitem__, split)))
        return out

    def _folded(self, text: bytes) -> bytes:
        """The text with ASCII letters lower-cased where that cannot change its ids."""
        if not self.lowers or _COMBINING.search(text):
            return text
        low = text.lower()
        return text if any(x.lower().encode() in low for x in self.special) else low


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """The worker's encoder for a vocabulary, kept from task to task."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encodes ``doc_id`` and ``text`` of all rows into files below ``path``; returns the manifest."""
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encode = encoder(tokenizer_file)
        context = TaskContext.get()
        shard = context.partitionId()
        store, root = open_fs(path)
        name = f"part-{shard:06d}.zst"
        temporary = f"{root}/.{name}.{context.taskAttemptId()}"
        writer = out = None
        for batch in batches:
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temporary)
                writer = Writer(out)
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                writer.add(doc_id, encode.encode([text.as_py()])[0] + end)
        if writer is None:
            return
        n_docs, n_tokens = writer.close()
        out.close()
        store.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(files or shuffle_width(spark), F.asc_nulls_first("doc_id"), "tie")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").drop("tie")
    manifest = rows.mapInArrow(lean(write), "shard long, file string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """All documents of a written folder: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, name = open_fs(row["file"])
                with store.open_input_file(name) as src:
                    reader = Reader(src)
                    for lo in range(0, len(reader.ids), 1000):
                        some = range(lo, min(lo + 1000, len(reader.ids)))
                        raw = [reader.tokens(i) for i in some]
                        out = {
                            "doc_id": pa.array([int(reader.ids[i]) if reader.known[i] else None for i in some], pa.int64()),
                            "start": pa.array([row["base"] + int(reader.offsets[i]) for i in some], pa.int64()),
                            "n_tokens": pa.array([int(reader.counts[i]) for i in some], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([np.frombuffer(r, "<u4").astype(np.int64) for r in raw], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(out)

    manifest = spark.read.schema("shard long, file string, n_docs long, n_tokens long").parquet(f"{path}/manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return files.repartition(max(shuffle_width(spark), 1), "shard").mapInArrow(read, schema)


def encode_and_read(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Writes all documents to a fresh folder in the shared place and reads them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_file)
    return read_tokens(spark, path, with_ids=False)
