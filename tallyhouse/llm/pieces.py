"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is encoded by an agenda of adjacent symbol pairs, ordered by the score of
the piece that a pair would make and then from left to right: the best pair is
merged, its new neighbours join the agenda, and pairs that a merge used up are
skipped when they come up. Symbols that are no piece fall back to their bytes.

No piece of such a vocabulary goes on after a space that follows something else
(checked when the file is read; otherwise a whole text is one section). So a text
falls into sections of spaces and what follows them, no merge crosses from one to
the next, and the agenda runs once per section that a worker has not seen lately.
Sections that are new are also encoded by the sentencepiece library, in one call
per Arrow batch, and a difference fails the job.

Ids leave as they become known and go through the decoder at once, which keeps
the bytes of an unfinished character and whether the text's first space is still
to come. A worker holds one Arrow batch, one block of a text and a bounded memo.

Defined results: a null or empty text has only its begin and end ids and decodes
to an empty text. Strings of control pieces inside a text are plain text. U+2581
stands for a space, as in the library. Repeated rows are encoded each; a null id
stays null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add
from sys import byteorder

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import importable

#: Fixed value: how pieces write a space.
SPACE = "▁"
#: Sections a worker remembers; a bound on memory, not on results.
MEMO = 600_000
#: Longer sections are not remembered.
LONG = 256
#: Characters that are encoded and digested at a time.
BLOCK = 1 << 16
#: Rows of a batch that are checked against the library in one call.
ROWS = 64

SECTIONS = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


# Bytes that are no UTF-8 become one U+FFFD each, as in the library.
codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Vocabulary:
    """Pieces of a merge-type model file, their ids and scores."""

    def __init__(self, path: str):
        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.costs: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = int(piece[3:-1], 16)
            elif not model.is_control(i) and not model.is_unknown(i):
                if model.is_unused(i):
                    raise ValueError("vocabularies with unused pieces are not supported")
                self.ids[piece] = i
                self.costs[piece] = -model.get_score(i)
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces to fall back to")
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.texts = {i: piece.replace(SPACE, " ") for piece, i in self.ids.items()}
        self.apart = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        shown = ["", " a", "a  b ", "ﬁ"]
        if [model.decode(model.encode(t)) for t in shown] != shown:
            raise ValueError("the model changes texts before it cuts them")

    def merge(self, section: str) -> list[int]:
        """Ids of one section by the agenda."""
        text = list(section)
        last = len(text)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        costs = self.costs
        agenda = [
            (costs[made], i, made)
            for i, made in enumerate(map(add, text, text[1:]))
            if made in costs
        ]
        heapify(agenda)
        while agenda:
            _, i, made = heappop(agenda)
            left, j = text[i], after[i]
            if not left or j == last or left + text[j] != made:
                continue
            text[i], text[j] = made, ""
            after[i] = k = after[j]
            if k < last:
                before[k] = i
                whole = made + text[k]
                if whole in costs:
                    heappush(agenda, (costs[whole], i, whole))
            h = before[i]
            if h >= 0:
                whole = text[h] + made
                if whole in costs:
                    heappush(agenda, (costs[whole], h, whole))
        out: list[int] = []
        for symbol in text:
            if symbol:
                known = self.ids.get(symbol)
                if known is None:
                    out += [self.byte_ids[b] for b in symbol.encode("utf-8")]
                else:
                    out.append(known)
        return out


class Decoder:
    """Ids in, text out as soon as its last byte is there."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.chars = codecs.getincrementaldecoder("utf-8")("each-byte")
        self.at_start, self.in_bytes = True, False

    def feed(self, ids: Iterable[int]) -> str:
        texts, of_bytes, out = self.vocabulary.texts, self.vocabulary.bytes, []
        for i in ids:
            piece = texts.get(i)
            if piece is None:
                if i in of_bytes:
                    self.in_bytes = True
                    out.append(self.chars.decode(bytes([of_bytes[i]])))
                continue
            if self.in_bytes:
                self.in_bytes = False
                out.append(self.chars.decode(b"", True))
            out.append(piece)
        text = "".join(out)
        if self.at_start and text:
            self.at_start = False
            text = text.removeprefix(" ")
        return text

    def finish(self) -> str:
        rest = self.chars.decode(b"", True) if self.in_bytes else ""
        self.in_bytes = False
        return rest


class Codec:
    """Encodes and decodes with a memo of sections: their ids as bytes, their text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, tuple[bytes, str]] = {}

    def sections(self, text: str) -> list[str]:
        """Sections of a text that follows a space; most begin with just one."""
        if SPACE not in text:
            parts = text.split(" ")
            if "" not in parts and self.vocabulary.apart:
                return parts
        text = SPACE + text.replace(" ", SPACE)
        if not self.vocabulary.apart:
            return [text]
        # The memo's keys lack one space, with which every section begins here.
        return [s[1:] for s in SECTIONS.findall(text)]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """Sections of a text by blocks, which are cut where a run of spaces begins."""
        if not text:
            return
        start = 0
        while self.vocabulary.apart and len(text) - start > BLOCK:
            end = text.find(" ", start + BLOCK)
            while end >= 0 and text[end - 1] in (" ", SPACE):
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield self.sections(text[start:end])
            start = end + 1
        yield self.sections(text[start:])

    def learn(self, sections: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and texts of sections that are not in the memo, checked by the library."""
        new = list(sections)
        vocabulary, out = self.vocabulary, {}
        decoder = Decoder(vocabulary)
        decoder.at_start = False
        # The library puts the first space before each text; an empty one gets none.
        given = vocabulary.library.encode([s.replace(SPACE, " ") for s in new if s], num_threads=1)
        checks = iter(given)
        for section in new:
            ids = vocabulary.merge(SPACE + section)
            if section and ids != next(checks):
                raise ValueError(f"the sentencepiece library differs for {section[:80]!r}")
            packed = array("I", ids)
            if byteorder == "big":
                packed.byteswap()
            out[section] = packed.tobytes(), decoder.feed(ids) + decoder.finish()
        return out

    def prepare(self, texts: Iterable[str]) -> list[list[list[str]] | None]:
        """Learn all new sections of a batch in one call of the library.

        Returns the sections of texts of one block, None for longer texts.
        """
        if len(self.known) >= MEMO:
            self.known.clear()
        new, cut = set(), []
        for text in texts:
            short = len(text) <= BLOCK
            blocks = list(self.blocks(text)) if short else self.blocks(text)
            cut.append(blocks if short else None)
            for block in blocks:
                new.update(block)
        known = self.known
        known.update(self.learn(s for s in new if s not in known and len(s) <= LONG))
        return cut

    def stream(self, text: str, blocks: list[list[str]] | None = None) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and their text, by blocks."""
        begin, end = (i.to_bytes(4, "little") for i in (self.vocabulary.begin, self.vocabulary.end))
        yield begin, ""
        known, first = self.known, True
        for block in self.blocks(text) if blocks is None else blocks:
            try:
                pairs = [known[s] for s in block]
            except KeyError:
                pairs = [known.get(s) or self.learn([s])[s] for s in block]
            packed, pieces = zip(*pairs)
            decoded = "".join(pieces)
            yield b"".join(packed), decoded.removeprefix(" ") if first else decoded
            first = False
        yield end, ""

    def encode(self, text: str) -> list[int]:
        ids = array("I", b"".join(packed for packed, _ in self.stream(text)))
        if byteorder == "big":
            ids.byteswap()
        return ids.tolist()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker and file."""
    return Codec(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), key


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, ids`` for every row, with begin and end ids; ``path`` is on every node."""
    rows, key = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(path)
        for batch in slices(batches):
            texts = _texts(batch)
            machine.prepare(texts)
            ids = pa.array([machine.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc", "ids"])

    return importable(rows).mapInArrow(run, f"doc {key}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc, text`` of ``doc, ids`` by the decoder's state machine; null ids are none."""
    key = encoded.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(codec(path).vocabulary)
        for batch in slices(batches):
            texts = []
            for ids in batch.column(1).to_pylist():
                machine.reset()
                texts.append(machine.feed(ids or []) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc", "text"])

    return importable(encoded.select("doc", "ids")).mapInArrow(run, f"doc {key}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n_tokens, ids_sha256, decoded_sha256``, encoded and decoded by blocks.

    Neither the ids nor the decoded text of a document is ever held as a whole.
    """
    rows, key = _rows(docs, id_col, text_col)
    schema = f"doc {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def one(machine: Codec, text: str, cut: list[list[str]] | None) -> tuple[int, str, str]:
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for packed, piece in machine.stream(text, cut):
            n += len(packed) // 4
            ids.update(packed)
            decoded.update(piece.encode("utf-8"))
        return n, ids.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(path)
        for batch in slices(batches):
            texts = _texts(batch)
            found = [one(machine, t, cut) for t, cut in zip(texts, machine.prepare(texts))]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                ["doc", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return importable(rows).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
