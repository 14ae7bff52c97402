"""Operator 2: byte-level BPE encoding and decoding over a trie of distinct words.

A text is cut into words by the tokenizer's own pattern; no merge crosses a
word. The encoding of a byte string is fixed by the *last token* of each of
its prefixes: the last token of a prefix ``p`` is the only token ``t`` that
ends ``p`` and may stand after the last token of ``p`` without ``t``. This
state depends on the prefix alone, so the distinct new words of a block are
put into one trie and the states are handed down depth first; a prefix that
many words share is encoded once. Words already seen come from a bounded
cache of the Python worker.

All of it is a map over the rows: no shuffle, memory bounded by the block
size, the cache size and the longest single text. A lost task is simply run
again.

Defined cases: a null or empty text has no tokens and decodes to ''; a null
id is kept; repeated rows give equal rows; an empty table gives no rows;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import pieces

BLOCK_CHARS = 1 << 20       # characters of text handled at a time
BLOCK_WORDS = 200_000       # words of one long text handled at a time
CACHE_WORDS = 800_000       # words whose ids a worker remembers, some 250 bytes each

# The split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Up to here the letter and number classes of the regex module equal the tokenizers library's; texts with later
# characters are cut by the library's own pre-tokenizer.
SAME_CLASSES = re.compile("[՘-\U0010ffff]")


# Splits that stand whatever is around them: between a word and the blank before the next, and between a letter or
# digit and a mark of punctuation. Letters of scripts written without blanks, and marks, that have been such
# in every version of Unicode, so that both libraries class them alike.
LETTERS = "0-9A-Za-zก-ะぁ-ゖァ-ヺ一-龥가-힣ऄ-ह"
MARKS = ",.!?;:。、，！？；：「」『』（）《》।"
BORDER = re.compile(rf"(?<=\w)(?= \w)|(?<=[{LETTERS}])(?=[{MARKS}])")


def cut_safely(text: str, size: int):
    """Parts of a text of about ``size`` characters, cut only where the pattern splits whatever stands around."""
    at = 0
    while len(text) - at > size:
        m = BORDER.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, as character → byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, their making (left, right, rank) and the test of neighbouring tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        model = spec["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items()
                    if all(c in to_byte for c in s)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (raw(s) for s in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = self.ids[left + right]
            pair = (self.ids[left], self.ids[right])
            self.merges[pair] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, pair
        # tokens by their bytes read backwards: byte → (further bytes, token that ends the walk here or -1)
        self.back: dict = {}
        for b, i in self.ids.items():
            level = self.back
            for c in b[:0:-1]:
                level = level.setdefault(c, [{}, -1])[0]
            level.setdefault(b[0], [{}, -1])[1] = i
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.word = {i: i.to_bytes(4, "little") for i in self.bytes}
        self.memo: dict[int, bool] = {}
        self.words = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def fits(self, a: int, b: int) -> bool:
        """Whether the texts of tokens ``a`` and ``b`` together encode to exactly ``a, b``.

        Merges run in rank order. Seen backwards in time, the tokens touching
        the border are ``a`` and ``b``, then their inner halves, and so on; a
        merge across the border spoils the pair if its rank comes before the
        merge that used up either neighbour (at equal rank the left one wins).
        """
        key = a << 20 | b
        known = self.memo.get(key)
        if known is not None:
            return known
        rank, parts, never = self.rank, self.parts, 1 << 60
        left, right = a, b
        left_used, right_used = never, never
        good = True
        while True:
            across = self.merges.get((left, right), never)
            if across < left_used and across <= right_used and across != never:
                good = False
                break
            made_left, made_right = rank.get(left, -1), rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right or (made_left == made_right and left != right):
                left, left_used = parts[left][1], made_left
            else:
                right, right_used = parts[right][0], made_right
        if len(self.memo) > 2_000_000:
            self.memo.clear()
        self.memo[key] = good
        return good

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids (little-endian 32 bit) of each distinct word, by one walk over the trie of all words."""
        collects = gc.isenabled()
        gc.disable()        # the trie is a tree: looking for cycles among its nodes costs as much as the walk
        try:
            return self._walk(words)
        finally:
            if collects:
                gc.enable()

    def _walk(self, words) -> dict[str, bytes]:
        root: dict = {}
        for w in words:
            node = root
            for c in w.encode():
                if c in node:
                    node = node[c]
                else:
                    node[c] = node = {}
            node[-1] = w
        found: dict[str, bytes] = {}
        back, fits, known, size, word = self.back, self.fits, self.memo.get, self.size, self.word
        path: list[int] = []
        last: list[int] = []            # last token of the prefix that ends with each byte of the path
        stack = [(0, c, child) for c, child in root.items() if c != -1]
        if -1 in root:
            found[root[-1]] = b""
        while stack:
            depth, byte, node = stack.pop()
            del path[depth:], last[depth:]
            path.append(byte)
            level, at = back, depth
            while True:
                if at < 0 or (step := level.get(path[at])) is None:
                    raise ValueError("a byte without a token")
                level, token = step
                if token >= 0:
                    if at == 0:
                        break
                    before = last[at - 1]
                    good = known(before << 20 | token)
                    if good or (good is None and fits(before, token)):
                        break
                at -= 1
            last.append(token)
            depth += 1
            for c, child in node.items():
                if c != -1:
                    stack.append((depth, c, child))
                else:
                    ids, at = [], depth
                    while at:
                        token = last[at - 1]
                        ids.append(word[token])
                        at -= size[token]
                    ids.reverse()
                    found[child] = b"".join(ids)
        return found

    def blocks(self, text: str):
        """The words of a text in order, in lists of bounded length; special tokens as their id."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > at:
                yield from self.plain(text[at:m.start()])
            yield self.special[m.group()]
            at = m.end()
        if at < len(text):
            yield from self.plain(text[at:] if at else text)

    def plain(self, text: str):
        if SAME_CLASSES.search(text):
            for part in cut_safely(text, BLOCK_CHARS):
                yield [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        elif len(text) <= BLOCK_CHARS:
            yield self.words.findall(text)
        else:
            it = (m.group() for m in self.words.finditer(text))
            while part := list(islice(it, BLOCK_WORDS)):
                yield part


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """A worker's vocabulary with its bounded word cache."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.cache: dict[str, bytes] = {}

    def ids_of(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, fresh, held = [], set(), 0

        def settle():
            if fresh:
                cache.update(self.vocab.encode_words(fresh))
            for k, part in waiting:
                out[k].append(b"".join(map(cache.__getitem__, part)))

        for k, text in enumerate(texts):
            for part in self.vocab.blocks(text):
                if isinstance(part, int):       # an added token stands for itself
                    cache[part] = part.to_bytes(4, "little")
                    waiting.append((k, [part]))
                    continue
                fresh.update(w for w in part if w not in cache)
                waiting.append((k, part))
                held += len(part)
                if held > BLOCK_WORDS:
                    settle()
                    waiting, fresh, held = [], set(), 0
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
        settle()
        return [b"".join(parts) for parts in out]

    def text_of(self, ids: bytes) -> str:
        tokens = memoryview(ids).cast("I").tolist()
        return b"".join(map(self.vocab.bytes.__getitem__, tokens)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids`` (little-endian 32-bit ids) and, if asked, ``decoded``.

    ``decoded`` is the text that the ids give back, made in the same task so
    that the ids need not travel twice; ``decode`` does it for stored ids.
    """
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            id_type = batch.schema.field("id").type
            for rows in pieces(batch, ("id", "text"), lambda r: len(r[1]), BLOCK_CHARS):
                ids = enc.ids_of([r[1] for r in rows])
                columns = {"id": pa.array([r[0] for r in rows], id_type),
                           "n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()),
                           "ids": pa.array(ids, pa.binary())}
                if with_decoded:
                    columns["decoded"] = pa.array([enc.text_of(b) for b in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * with_decoded
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``decoded``, the text of its ids (null ids: '')."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            id_type = batch.schema.field("id").type
            for rows in pieces(batch, ("id", "ids"), lambda r: len(r[1]) // 4, BLOCK_CHARS):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r[0] for r in rows], id_type),
                    "decoded": pa.array([enc.text_of(r[1]) for r in rows], pa.string())})

    return source.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per document: token count and the digests of its ids and of the decoded text."""
    return encode(df, path, with_decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
