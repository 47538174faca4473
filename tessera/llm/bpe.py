"""BPE encoding and decoding through a distinct-word table.

Texts are cut into words by the byte-level pre-tokenisation pattern, in the tasks that read them, and packed into
blocks: a block keeps its distinct words, numbered, and for each text the numbers of its words in their order. The
distinct words of all blocks are dealt by their hash to the parts of the word table, where each distinct word of the
corpus is encoded once and every block that has it is answered with its ids. Answers are joined to their blocks, and
the numbers pick the ids position by position. So a word crosses the network once for each block that has it and not
once for each place where it stands. Decoding joins ids with the id-to-piece table.

Blocks end at BLOCK_BYTES of text (a longer text is a block of its own) or BLOCK_TEXTS texts, parts are as many as the
words of the blocks ask for, so neither a task's rows nor its table grow with the corpus.

Defined results: a null text counts as the empty text; the empty text has no ids and decodes to itself. The
marker of a special token inside a text becomes that token's id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, deal, map_batches, table, texts

#: Production parameters: bytes and texts of a block, bytes of words in one part of the word table, and the words of a block whose ids are worked on at once.
BLOCK_BYTES, BLOCK_TEXTS, PART_BYTES, STEP = 16 << 20, 16_384, 8 << 20, 1 << 17

#: The pre-tokenisation pattern of byte-level BPE, with white space by its Unicode property.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, the other bytes follow from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged table, one after another, and their lengths. Of STEP rows at a time, as places take up to eight times the room of what stands there."""
    out, sizes = [], []
    for a in range(0, max(1, len(rows)), STEP):
        start = offsets[rows[a : a + STEP]]
        size = offsets[1:][rows[a : a + STEP]] - start
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size)
        at += np.arange(len(at), dtype=np.int64)
        out.append(values[at])
        sizes.append(size)
    return (np.concatenate(out), np.concatenate(sizes)) if len(out) > 1 else (out[0], sizes[0])


class Words:
    """What one tokenizer does with texts, words and ids.

    A word here starts at a space that a visible character follows: the pattern always cuts there, so the ids of a
    text are those of its words in a row. Texts with other uses of the space are cut by the pattern itself.
    """

    def __init__(self, tokenizer_json: str):
        import regex

        spec = json.loads(tokenizer_json)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encode_word = self.encoder(tokenizer_json, {bytes(alphabet[c] for c in w): i for w, i in vocab.items()}, spec["model"]["merges"], vocab)
        self.split = regex.compile(WORD_PATTERN).findall
        self.marker = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = regex.compile(r" (?:\p{White_Space}|$)").search
        pieces = {i: bytes(alphabet[c] for c in word) for word, i in vocab.items()}
        pieces |= {i: word.encode() for word, i in self.special.items()}
        sizes = [len(pieces.get(i, b"")) for i in range(max(pieces) + 1)]
        self.piece_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.piece = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(sizes))), np.uint8)

    @staticmethod
    def encoder(tokenizer_json: str, ranks: dict[bytes, int], merges: list, vocab: dict[str, int]):
        """Ids of one word. Where ids follow the order of the merges, ranks say the same as the merges and are quicker."""
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        if order == list(range(256, 256 + len(order))):
            import tiktoken

            pattern = WORD_PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
            return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda word: tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, word: str) -> list[int]:
        """Ids of a word of ``words``."""
        return [self.special[word]] if word in self.special else self.encode_word(word)

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """Words of a text: those that stand as they are, and then those without the space in front."""
        if self.marker is not None and any(m in text for m in self.special):
            return [w for k, part in enumerate(self.marker.split(text)) for w in ([part] if k % 2 else self.split(part))], []
        if self.odd(text):
            return self.split(text), []
        first, *rest = text.split(" ")
        return [first] if first else [], rest

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the pieces, one after another, and the number of bytes of each id."""
        return gather(self.piece_at, self.piece, ids)


class Block:
    """Texts as numbers of distinct words, in the order in which they first occur."""

    def __init__(self):
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}  # without their space
        self.words: list[bytes] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, words: tuple[list[str], list[str]], size: int) -> None:
        at = []
        for known, own, before in ((self.plain, words[0], ""), (self.spaced, words[1], " ")):
            new = [w for w in dict.fromkeys(own) if w not in known]
            known.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words += [(before + w).encode() for w in new]
            at.append(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))
        self.places.append(np.concatenate(at))
        self.ids.append(doc_id)
        self.sizes.append(len(self.places[-1]))
        self.held += size

    def rows(self, parts: int) -> list[tuple]:
        """(block, kind, part, ids, sizes, places, words): the texts (kind 0), and the words dealt to each part (kind 1). Takes no more texts after that."""
        import uuid

        import xxhash

        self.plain, self.spaced = {}, {}
        data = self.words
        part = (np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data)) % np.uint64(parts)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        block = uuid.uuid4().int >> 65
        places = np.concatenate(self.places, dtype=np.uint32)
        self.places = []
        out = [(block, 0, -1, self.ids, np.array(self.sizes, np.int64).tobytes(), _packed(_referred(places)), _packed(part))]
        cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                out.append((block, 1, p, None, None, None, _words_packed([data[k] for k in order[a:b].tolist()])))
        return out


def _referred(places: np.ndarray) -> np.ndarray:
    """0 where a word occurs for the first time, whose number is the next one; else its number plus 1."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] > np.maximum.accumulate(places)[:-1]
    out = places + np.uint32(1)
    out[new] = 0
    return out


def _placed(code: np.ndarray) -> np.ndarray:
    out = np.cumsum(code == 0, dtype=np.uint32)
    out -= 1
    return np.subtract(code, np.uint32(1), out=out, where=code != 0)


def _words_packed(words: list[bytes]) -> bytes:
    """Words, without a line break inside, as lines; those with one by their sizes."""
    plain = not any(b"\n" in w for w in words)
    body = b"\n".join(words) if plain else np.array([len(words), *map(len, words)], np.uint32).tobytes() + b"".join(words)
    return bytes([plain]) + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _words_opened(packed: bytes) -> list[bytes]:
    body = pa.decompress(packed[9:], int.from_bytes(packed[1:9], "little"), codec="zstd", asbytes=True)
    if packed[0]:
        return body.split(b"\n")
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    at = (np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint32, n, 4), dtype=np.int64)]) + 4 * (n + 1)).tolist()
    return [body[a:b] for a, b in zip(at, at[1:])]


def _packed(x: np.ndarray) -> bytes:
    """Small numbers: their bytes in planes, of which the upper ones compress away."""
    planes = np.ascontiguousarray(x.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def _opened(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(b[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


@lru_cache(1)
def of_tokenizer(tokenizer_json: str) -> Words:
    """The tables of this Python worker, which Spark keeps from task to task; they depend on the vocabulary alone."""
    return Words(tokenizer_json)


_ROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()), ("words", pa.binary())])


def split_words(docs: DataFrame, tokenizer_json: str, parts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Blocks of texts, and their distinct words by part, each as a table of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = of_tokenizer(tokenizer_json), Block()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block.rows(parts)), _ROW)], schema=_ROW)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                block.add(i, words.words(text) if text else ([], []), len(text or ""))
                if block.held >= BLOCK_BYTES or len(block.ids) >= BLOCK_TEXTS:
                    yield out()
                    block = Block()
        if block.ids:
            yield out()

    return scratch.save_kinds(map_batches(texts(docs), run, "block long, kind int, part int, ids array<long>, sizes binary, places binary, words binary"))


def encode_words(split: DataFrame, tokenizer_json: str, parts: int, scratch: Scratch) -> DataFrame:
    """The word table: (block, part, sizes, places), the numbers of ids and the ids of a block's words of that part, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, now = of_tokenizer(tokenizer_json), {}, None  # ids as bytes: a list of integers takes three times the room
        for batch in batches:
            out = []
            for block, part, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "words"))):
                if part != now:
                    known, now = {}, part
                own = _words_opened(packed)
                for w in own:
                    if w not in known:
                        known[w] = array("I", words.encode(w.decode())).tobytes()
                ids = [known[w] for w in own]
                out.append((block, part, _packed(np.fromiter(map(len, ids), np.uint32, len(ids)) // np.uint32(4)), _packed(np.frombuffer(b"".join(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "part", "sizes", "places"])

    asked = split.select("block", "part", "words")
    return scratch.save(map_batches(deal(asked, "part", parts), run, "block long, part int, sizes binary, places binary"))


def encode_texts(docs: DataFrame, tokenizer_json: str, digest: bool = False, parts: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens and either (ids, decoded) or their digests (ids_sha256, decoded_sha256)."""
    scratch = scratch or Scratch(docs.sparkSession)
    if parts is None:  # the distinct words of a block are a small share of its bytes, by far
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        parts = max(12, -(-size // (8 * PART_BYTES)))
    blocks, asked = split_words(docs, tokenizer_json, parts, scratch)
    answers = encode_words(asked, tokenizer_json, parts, scratch)
    scratch.drop(asked)
    both = blocks.select("block", "part", "ids", "sizes", "places", "words").unionByName(answers, allowMissingColumns=True)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = of_tokenizer(tokenizer_json)

        def out(docs: list, sizes: bytes, places: bytes, part: bytes, answers: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            per_word = np.concatenate([np.zeros(1, np.int64), *(_opened(a) for a, _ in answers)]).cumsum()
            table, rows = np.concatenate([np.zeros(0, np.uint32), *(_opened(b) for _, b in answers)]).astype(np.uint32), _placed(_opened(places))
            order = np.argsort(_opened(part), kind="stable")  # answers come part by part
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            rows = rank[rows]
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
            a = 0
            while a < len(docs):  # as many texts at a time as have STEP words
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, side="right")) - 1)
                ids, size = gather(per_word, table, rows[ends[a] : ends[b]])
                at = np.concatenate([[0], np.cumsum(size)])[ends[a : b + 1] - ends[a]]
                raw, width = words.decode(ids)
                of = np.concatenate([[0], np.cumsum(width)])
                spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
                back = [raw[of[x] : of[y]].tobytes() for x, y in spans]
                fix = lambda x: x.decode("utf-8", "replace")
                if digest:
                    last = [[hashlib.sha256(ids[x:y].astype("<u4").tobytes()).hexdigest() for x, y in spans], [hashlib.sha256(fix(x).encode()).hexdigest() for x in back]]
                else:
                    last = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), [fix(x) for x in back]]
                yield pa.RecordBatch.from_arrays([pa.array(docs[a:b], pa.int64()), pa.array(np.diff(at), pa.int64()), *(x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in last)], schema=_arrow(digest))
                a = b

        now, told = None, []
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "ids", "sizes", "places", "words"))):
                if part == -1:
                    if now is not None:
                        yield from out(*now, told)
                    now, told = row, []
                else:
                    told.append(row[1:3])
        if now is not None:
            yield from out(*now, told)

    return map_batches(both.repartition("block").sortWithinPartitions("block", "part"), run, schema)


def _arrow(digest: bool) -> pa.Schema:
    rest = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *rest])


def decode_ids(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, decoded), by the id-to-piece table. Null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = of_tokenizer(tokenizer_json)
        for batch in batches:
            out = [words.decode(np.array(ids or [], np.int64))[0].tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, decoded string")


def tokenizer_file(path: str | None = None) -> str:
    """Content of the vocabulary file, some 2 MB whatever the corpus; it travels with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_file(), digest=True)
