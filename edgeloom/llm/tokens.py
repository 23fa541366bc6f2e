"""Token ids as flat binary files with 64-bit offsets, memory-mapped.

Format: a folder with, for each range of doc_ids in ascending order, `NNNNN.ids` (little-endian unsigned integers of
16 bits if the vocabulary allows, else 32; each document ends with the end id), `NNNNN.off` (int64 offsets of its
documents, from 0, one more than documents) and `NNNNN.doc` (int64 doc_ids), and `manifest.json` with the element
type and each part's base in ids and in documents. The bases are prefix sums of the parts' sizes, so a document's
global start is base + offset. A task writes to temporary names and renames, so a repeated task does no harm.

The folder must be mounted on all machines (file://): memory mapping needs a path.

A null text is empty and has only the end id. Null doc_ids come first and are written as the smallest int64. Rows
with equal doc_ids stay, in the order of their texts. An empty table gives a folder without parts.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import column, local_path, new_folder, partitions_for, text_rows

_BEFORE_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}] "
#: A stop or comma that isn't after a word, or more white space than a line feed.
_TANGLED = r"(^|[^\pL\pN])[.,]([ \n]|$)|\n([\s\x0b\x1c-\x1f\x85\p{Z}]|$)"
NO_ID = -(1 << 63)
#: Marks of what stands after a word, or after a line feed, without a space.
AFTER_WORD, AFTER_FEED = "\0", "\1"
#: Words that an encoder remembers.
CACHE = 500_000


class Encoder:
    """Encodes texts with a file of the tokenizers library, as bytes of ids.

    Pre-tokenisation starts a new piece at each single space between two characters that aren't white space, at a stop
    or comma after a word, and at a line feed and after it. So the runs between them are encoded once, remembered, and
    put together by number; other texts go to the library whole.
    """

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.end = array(self.code, [end_id]).tobytes()
        self.known: dict[str, bytes] = {}  # ids of runs after a space
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer")
        vocabulary = self.tokenizer.get_vocab()
        self.spaces = np.zeros(max(vocabulary.values()) + 1, bool)
        self.feeds = self.spaces.copy()
        for token, i in vocabulary.items():  # how a byte-level vocabulary writes a space and a line feed
            self.spaces[i], self.feeds[i] = token.startswith("\u0120"), token.startswith("\u010a")
        self.marks = dict(zip(".,\n ", self.ids([".", ",", "\n", " "]), strict=True))
        self.fixed = {AFTER_WORD + ".": self.marks["."], AFTER_WORD + ",": self.marks[","], AFTER_WORD + ".\n": self.marks["."] + self.marks["\n"], "": self.marks[" "]}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text on its own."""
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str], mark: str) -> list[bytes]:
        """The ids of words without white space; many go as one text. Each stands after a space, or after a line feed,
        whose own token isn't the word's: so the tokens that start with a mark tell the words apart."""
        out: list[bytes] = []
        starts, skip = (self.spaces, 0) if mark == " " else (self.feeds, 1)
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([mark + mark.join(some)], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(starts[ids])
            raw, width = ids.astype(f"<u{len(self.end)}").tobytes(), len(self.end)
            if len(at) == len(some):
                cuts = (at * width).tolist()
                out += [raw[a + skip * width : b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
            else:
                out += self.ids([mark * (1 - skip) + w for w in some])
        return out

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of runs. A run stands after a single space, or with a mark after a word or a line feed. A
        stop or comma after a word is a piece of its own."""
        known = self.known
        plain, starts, ends, odd = [], [], [], []
        for w in new:
            if w.isalnum() or w[-1] not in ".," and w[0] > AFTER_FEED and w.split() == [w]:
                plain.append(w)
            elif w[0] == AFTER_FEED and w[1:].isalnum():
                starts.append(w)
            elif w[-1] in ".," and w[:-1].isalnum():
                ends.append(w)
            else:
                odd.append(w)
        known.update(zip(plain, self.joined(plain, " "), strict=True))
        known.update(zip(starts, self.joined([w[1:] for w in starts], "\n"), strict=True))
        stems = list({w[:-1] for w in ends if w[:-1] not in known})
        known.update(zip(stems, self.joined(stems, " "), strict=True))
        known.update((w, known[w[:-1]] + self.marks[w[-1]]) for w in ends)
        known.update(zip(odd, self.ids([w[1:] if w[0] in (AFTER_WORD, AFTER_FEED) else " " + w for w in odd]), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each text has."""
        texts = texts.cast(pa.string()).fill_null("")
        n = len(texts)
        # A space after white space isn't single: such a text goes to the library whole, as the head of an empty one. So
        # does a text that holds one of the marks.
        single = pc.invert(pc.or_(pc.match_substring_regex(texts, _BEFORE_SPACE + r"|[\x00\x01]"), pc.starts_with(texts, " "))) if self.splits else pa.array([False] * n)
        plain = pc.if_else(single, texts, "")
        marked = plain
        for old, new in ((", ", f" {AFTER_WORD}, "), (". ", f" {AFTER_WORD}. "), (".\n", f" {AFTER_WORD}.\n {AFTER_FEED}")):
            marked = pc.replace_substring(marked, old, new)
        lists = pc.split_pattern(pc.if_else(pc.match_substring_regex(plain, _TANGLED), plain, marked), " ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        runs = lists.flatten().dictionary_encode()
        heads = pc.if_else(single, lists.flatten().take(lists.offsets[:-1]), texts).to_pylist()

        names = runs.dictionary.to_pylist()
        if len(self.known) > CACHE:  # short words are the frequent ones
            self.known = {w: v for w, v in self.known.items() if len(w) < 8}
            if len(self.known) > CACHE // 2:
                self.known = {}
        self.known.update(self.fixed)
        found = list(map(self.known.get, names))
        gaps = [k for k, x in enumerate(found) if x is None]
        self.learn([names[k] for k in gaps])
        for k in gaps:
            found[k] = self.known[names[k]]
        found += [*self.ids(heads), self.end]

        # Runs, heads and ends in the order of the texts, as places in `found`; then their ids side by side.
        count, doc = np.diff(offsets), np.arange(n)
        order = np.empty(offsets[-1] + n, np.int64)
        order[np.arange(offsets[-1]) + np.repeat(doc, count)] = runs.indices.to_numpy()
        order[offsets[:-1] + doc] = len(names) + doc
        order[offsets[1:] + doc] = len(found) - 1
        ids = np.frombuffer(b"".join(found), f"<u{len(self.end)}")
        length = np.fromiter(map(len, found), np.int64, len(found)) // len(self.end)
        start = np.cumsum(length) - length
        length = length[order]
        ends = np.cumsum(length)
        place = np.repeat(start[order] - (ends - length), length) + np.arange(ends[-1] if n else 0)
        return ids[place], np.diff(ends[offsets[1:] + doc], prepend=0)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, per_part: int = 20_000) -> str:
    """Writes the ids of all texts in ascending doc_id order; returns the folder."""
    spark = docs.sparkSession
    url = folder or new_folder(spark, "tokens")
    path = local_path(url)
    os.makedirs(path, exist_ok=True)

    def run(batches):
        enc, name = encoder(tokenizer, end_id), uuid.uuid4().hex
        width, docs_, at = len(enc.end), 0, 0
        tmp = f"{path}/{name}"
        os.makedirs(path, exist_ok=True)
        with open(f"{tmp}.ids.tmp", "wb") as ids, open(f"{tmp}.off.tmp", "wb") as off, open(f"{tmp}.doc.tmp", "wb") as doc:
            off.write(array("q", [0]).tobytes())
            for batch in batches:
                if batch.num_rows:
                    coded, counts = enc.encode(column(batch, "text"))
                    ends = at + np.cumsum(counts)
                    ids.write(coded.tobytes())
                    off.write(ends.astype("<i8").tobytes())
                    doc.write(column(batch, "doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                    docs_, at = docs_ + batch.num_rows, int(ends[-1])
        for kind in ("ids", "off", "doc"):
            if docs_:
                os.replace(f"{tmp}.{kind}.tmp", f"{tmp}.{kind}")
            else:
                os.remove(f"{tmp}.{kind}.tmp")
        if docs_:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_], "tokens": [at], "name": [name], "width": [width]})

    docs = text_rows(docs)
    n = min(partitions_for(spark, rows := docs.count(), per_part), max(1, rows // 200 + 1))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text") if rows else docs
    parts = sorted(ordered.mapInArrow(run, "part long, docs long, tokens long, name string, width long").collect())
    manifest, token_base, doc_base = [], 0, 0
    for k, p in enumerate(parts):
        for kind in ("ids", "off", "doc"):
            os.replace(f"{path}/{p.name}.{kind}", f"{path}/{k:05d}.{kind}")
        manifest.append({"name": f"{k:05d}", "docs": p.docs, "tokens": p.tokens, "doc_base": doc_base, "token_base": token_base})
        token_base, doc_base = token_base + p.tokens, doc_base + p.docs
    kind = f"<u{parts[0].width if parts else 2}"
    with open(f"{path}/manifest.json.tmp", "w") as f:
        json.dump({"type": kind, "docs": doc_base, "tokens": token_base, "end_id": end_id, "parts": manifest}, f)
    os.replace(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    return url


class TokenFiles:
    """Memory-mapped reader: len(), [i] -> ids of the i-th document, and the parts."""

    def __init__(self, folder: str):
        self.path = local_path(folder)
        with open(f"{self.path}/manifest.json") as f:
            self.manifest = json.load(f)
        self.parts = self.manifest["parts"]
        self.bases = [p["doc_base"] for p in self.parts]

    def __len__(self) -> int:
        return self.manifest["docs"]

    def part(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, offsets and doc_ids of a part."""
        at = f"{self.path}/{name}"
        return np.memmap(f"{at}.ids", self.manifest["type"], "r"), np.memmap(f"{at}.off", "<i8", "r"), np.memmap(f"{at}.doc", "<i8", "r")

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect_right(self.bases, i) - 1
        ids, off, _ = self.part(self.parts[k]["name"])
        j = i - self.bases[k]
        return ids[off[j] : off[j + 1]]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    parts = TokenFiles(folder).parts
    table = spark.createDataFrame([(p["name"], p["token_base"]) for p in parts], "name string, base long")
    if parts:
        table = table.repartition(len(parts))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        files = TokenFiles(folder)
        for batch in batches:
            for name, base in zip(column(batch, "name").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                ids, off, doc = files.part(name)
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                keys = pa.array(np.array(doc), mask=np.array(doc) == NO_ID)
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + np.array(off[:-1])), pa.array(np.diff(off)), pa.array(crcs, pa.int64())], schema=schema)

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
