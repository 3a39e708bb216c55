"""Byte-pair encoding and decoding with tree concatenation.

A long text is cut into leaves that are encoded in parallel tasks. Neighbours are then joined pairwise up a
tree: the text around a join is encoded again in a window that grows until its first and last tokens are
exactly those which the two sides have in the same places. In a byte-pair encoding a sequence of tokens is the
encoding of its bytes if every two neighbours are; beyond such a window nothing can change.

Ordinary text is encoded by space-delimited chunks from a bounded cache: in this family of pre-tokenizers a
single space between two other characters always starts a piece. Chunks with white space at their front, or
texts with characters whose class depends on the Unicode version, go to the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import small_batches

LEAF = 32_768
#: Characters of one class in every Unicode version that a tokenizer may have been built with.
_KNOWN = re.compile("[\x00-\x1b\x20-\x84\x86-ɏͰ-ͷЀ-џ‐-‧‰-›€]*").fullmatch
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch
#: The pre-tokenizer's pattern. Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids of chunks that follow a space; up to ``limit`` are kept."""

    def __init__(self, core, limit: int):
        self.single, self.plain, self.limit = core._core_bpe.encode_single_piece, core.encode_ordinary, limit

    def __missing__(self, chunk: str) -> bytes | None:
        if not chunk or chunk[0].isspace():
            return None
        if m := _WORD(chunk):
            word, marks = m.groups()
            ids = self.get(word)
            if ids is None:
                ids = array("I", self.single((" " + word).encode())).tobytes()
                if len(self) < self.limit:
                    self[word] = ids
            if not marks:
                return ids
            ids += array("I", self.plain(marks)).tobytes()
        else:
            ids = array("I", self.plain(" " + chunk)).tobytes()
        if len(self) < self.limit:
            self[chunk] = ids
        return ids


def known_family(spec: dict) -> bool:
    """Whether a vocabulary file cuts and merges texts as PIECES and the chunks here do: byte-level, by the usual pattern,
    without a normalizer, a prefix space, whole-word matches or anything else that changes texts or merges."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk"))
    # ranks are ids here, so merges must come in the order of what they make
    ids = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    merges = merges and all(a < b for a, b in zip(ids[:-1], ids[1:], strict=True))
    marks = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec.get("added_tokens", []))
    return plain and merges and marks


class Codec:
    """Encoder and decoder of a byte-level vocabulary file of the tokenizers library, without its truncation and padding.

    Files of another family (``plain`` is false) go through the library whole, text by text."""

    def __init__(self, path: str, cache: int = 500_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain, symbols = known_family(spec), byte_symbols()
        vocab = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in symbols for c in token)}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        ranks = {b: i for b, i in vocab.items() if i not in added.values()}
        core = tiktoken.Encoding("granary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.core, self.added, self.chunks = core, added, _Chunks(core, cache)
        self.marks = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in added.items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, dtype=np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)

    def leaf(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a text that is encoded in one go."""
        if not self.plain or not _KNOWN(text) or (self.marks and self.marks.search(text)):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        head, space, rest = text.partition(" ")
        try:
            ids = array("I", self.core.encode_ordinary(head)).tobytes()
            return ids + b"".join(map(self.chunks.__getitem__, rest.split(" "))) if space else ids
        except TypeError:  # a chunk that must be seen with what stands before it
            return array("I", self.core.encode_ordinary(text)).tobytes()

    def encode(self, text: str, leaf: int = LEAF) -> bytes:
        if len(text) <= leaf or not self.plain:
            return self.leaf(text)
        return self.joined([(x, self.leaf(x)) for x in leaves(text, leaf)])

    def joined(self, parts: list[tuple[str, bytes]]) -> bytes:
        """Ids of the whole from (text, ids) of its leaves in order."""
        level = [(t.encode("utf-8"), np.frombuffer(i, "<u4")) for t, i in parts]
        while len(level) > 1:
            level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0][1].astype("<u4").tobytes()

    def join(self, a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        (left, x), (right, y) = a, b
        whole, ends, starts = left + right, np.cumsum(self.lengths[x]), np.cumsum(self.lengths[y])
        reach = 8
        while True:
            i, j = max(0, len(x) - reach), min(len(y), reach)
            # a window starts and ends between whole characters, outside white space (its pieces depend on what
            # follows it) and outside added tokens
            while i > 0 and not self._open(whole, int(ends[i - 1])):
                i -= 1
            while j < len(y) and not self._open(whole, len(left) + int(starts[j - 1])):
                j += 1
            lo, hi = (int(ends[i - 1]) if i else 0), (len(left) + int(starts[j - 1]) if j < len(y) else len(whole))
            window = np.frombuffer(self.leaf(whole[lo:hi].decode("utf-8")), "<u4")
            same_left = lo == 0 or (len(window) > 1 and window[0] == x[i] and window[1] == x[i + 1])
            same_right = hi == len(whole) or (len(window) > 1 and window[-1] == y[j - 1] and window[-2] == y[j - 2])
            if same_left and same_right:
                return whole, np.concatenate([x[:i], window, y[j:]])
            reach *= 2

    def _open(self, data: bytes, at: int) -> bool:
        """Whether a window may start or end at a place of data."""
        if 0x80 <= data[at] <= 0xBF:
            return False
        start = at - 1
        while 0x80 <= data[start] <= 0xBF:
            start -= 1
        if data[start:at].decode("utf-8").isspace():
            return False
        return all(data.find(m.encode(), max(0, at - len(m.encode()) + 1), at + len(m.encode()) - 1) < 0 for m in self.added)

    def decode(self, ids: np.ndarray) -> str:
        if not self.plain:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    return [text[k : k + leaf] for k in range(0, len(text), leaf)] or [""]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _digests(coder: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4")).encode("utf-8")).hexdigest()


_LEAF_ROWS = "rid long, leaf int, part string, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ROWS = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """Ids of docs' texts and the texts decoded from them, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as an empty one, which has no ids. Every row is encoded, rows with equal ids or texts too;
    no rows give none; other columns are ignored. Texts longer than ``leaf`` characters are encoded as leaves in
    separate rows and joined; one text's leaves must fit in a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    with open(path, encoding="utf-8") as f:
        leaf = leaf if known_family(json.load(f)) else (1 << 31) - 1
    cut = F.when(F.length(text) <= leaf, F.array(text)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / leaf).cast("int")), lambda i: F.substring(text, i * leaf + 1, F.lit(leaf)))
    )
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), cut.alias("parts"))
    parts = rows.select("doc_id", "rid", F.size("parts").alias("n"), F.posexplode("parts").alias("leaf", "part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            whole, ids, digests = [], [], []
            for n, part in zip(batch["n"].to_pylist(), batch["part"].to_pylist(), strict=True):
                got = coder.leaf(part)
                digests.append(_digests(coder, got) if n == 1 else (None, None, None))
                whole.append(None if n == 1 else part)
                ids.append(None if n == 1 else np.frombuffer(got, "<u4").astype(np.uint32).tobytes())
            n_tokens, of_ids, of_text = zip(*digests, strict=True) if digests else ((), (), ())
            columns = [batch["doc_id"], batch["rid"], batch["leaf"], pa.array(whole, pa.string()), pa.array(ids, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "leaf", "part", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    encoded = parts.mapInArrow(encode, f"doc_id {id_type}, {_LEAF_ROWS}")
    grouped = encoded.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")],
        F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("leaf", "part", "ids")))).alias("leaves"),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            got = list(zip(*[batch[c].to_pylist() for c in ("n_tokens", "ids_sha256", "decoded_sha256")], strict=True))
            for k, parts_of in enumerate(batch["leaves"].to_pylist()):
                if parts_of:
                    got[k] = _digests(coder, coder.joined([(p["part"], p["ids"]) for p in parts_of]))
            n_tokens, of_ids, of_text = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return grouped.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "leaves").mapInArrow(finish, _ROWS.format(id_type))
