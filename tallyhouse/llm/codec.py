"""BPE encoding and decoding as streaming transducers.

Encoding sends a token as soon as nothing that follows can change it: between
words always, inside a word when the live paths agree, which they do at the latest
after the merge list's lookahead (``Merges.lookahead``, a window of
``Merges.stream``). Texts are read in blocks that end at white space. Ids go on to
the decoder at once, a state machine from ids to text, and :func:`digests` feeds both
to incremental hashes: neither the ids nor the decoded text of a document is held.

The tokenizer files here name no decoder, for which the library joins the tokens'
names by spaces: the state machine then has one bit, whether anything was sent. With
a vocabulary of word ends, ``Decoder`` gives readable text by the bytes of the ids;
its state is the unfinished character and whether a word has ended.

Defined results: a null or empty text has no ids. Strings of special tokens inside
a text become those tokens, as the library does by default. Repeated rows are
encoded each. A null id stays null. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import bpe
from tallyhouse.llm.tables import held, importable, map_rows

BLOCK = 1 << 16
#: Words a worker remembers; a bound on memory, not on results.
MEMO = 400_000


class Encoder:
    def __init__(self, path: str):
        self.merges = bpe.load(path)
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = tuple(self.merges.encode(word))
            if len(word) < bpe.LONG_WORD:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for block in blocks(text):
            for section, token in bpe.sections(block, self.merges.special):
                if token is not None:
                    out.append(token)
                    continue
                known = self.known.get
                for word in bpe.words(section):
                    out += known(word) or self.word(word)
        return out


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Pieces of about ``size`` characters that end at white space."""
    start = 0
    while len(text) - start > size:
        ends = [i for s in " \n\t" if (i := text.find(s, start + size)) >= 0]
        if not ends:
            break
        yield text[start : min(ends)]
        start = min(ends)
    yield text[start:]


class Decoder:
    """Ids in, characters out as soon as their last byte is there.

    The state is the unfinished character and whether a word has just ended:
    words are separated by one space. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, merges: bpe.Merges):
        self.symbols = {i: s for s, i in merges.ids.items()}
        self.special = {i: s for s, i in merges.special.items()}
        self.reset()

    def reset(self) -> None:
        self.chars = codecs.getincrementaldecoder("utf-8")("replace")
        self.gap = False

    def feed(self, token: int) -> str:
        gap = " " if self.gap else ""
        if token in self.special:
            self.gap = True
            return self.chars.decode(b"", True) + gap + self.special[token]
        symbols = self.symbols[token]
        self.gap = ord(symbols[-1]) >= 256
        data = bytes(ord(c) & 255 for c in symbols)
        return gap + self.chars.decode(data, self.gap)

    def decode(self, ids: Iterable[int]) -> str:
        self.reset()
        return "".join(map(self.feed, ids)) + self.chars.decode(b"", True)


@held
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc, ids`` for every row; ``path`` is on every node."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )

    def one(doc, text: bytes):
        return [(doc, encoder(path).encode(text.decode("utf-8", "replace")))]

    return map_rows(rows, f"doc {key}, ids array<int>", one, most=512)


class Names:
    """Ids in, the tokens' names out, joined by spaces as they come."""

    def __init__(self, path: str):
        self.names = {i: f" {name}" for i, name in bpe.load(path).names.items()}
        self.reset()

    def reset(self) -> None:
        self.sent = False

    def feed(self, ids: Iterable[int]) -> str:
        """Text of further ids. The first of a text has no space before it."""
        names = self.names
        text = "".join([names[i] for i in ids])
        if self.sent or not text:
            return text
        self.sent = True
        return text[1:]


class Digester:
    """Encodes and decodes texts block by block into two hashes.

    A memo has, for words met before, what each adds to the hashed texts: its ids as
    decimal text and its names, both with a space before each. They are one string,
    ended by ``END`` each, as three objects a word would take twice the memory.
    """

    #: No byte of UTF-8.
    END = b"\xff"

    def __init__(self, path: str):
        self.merges, self.names = bpe.load(path), Names(path)
        # In the middle of a text; what comes first loses its space when it is sent.
        self.names.sent = True
        self.numbers = {i: b" %d" % i for i in self.merges.names}
        self.known: dict[str, bytes] = {}

    def added(self, ids) -> bytes:
        return b"".join([*[self.numbers[i] for i in ids], self.END, self.names.feed(ids).encode(), self.END])

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.added(self.merges.encode(word))
            if len(word) < bpe.LONG_WORD:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[word] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        special = self.merges.special
        for block in blocks(text):
            for section, token in bpe.sections(block, special):
                if token is not None:
                    parts = [self.added([token])]
                else:
                    words, known = bpe.words(section), self.known
                    try:
                        parts = [known[w] for w in words]
                    except KeyError:
                        parts = [known.get(w) or self.word(w) for w in words]
                if not parts:
                    continue
                both = b"".join(parts).split(self.END)
                id_text, name_text = b"".join(both[::2]), b"".join(both[1::2])
                # Only the first token of a text has no space before it.
                ids.update(id_text if n else id_text[1:])
                decoded.update(name_text if n else name_text[1:])
                n += id_text.count(b" ")
        return n, ids.hexdigest(), decoded.hexdigest()


@held
def digester(path: str) -> Digester:
    return Digester(path)


def digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc, n_tokens, ids_sha256, decoded_sha256``: encoded, and decoded from the ids.

    The ids are digested as decimal numbers joined by one space, the decoded text in
    UTF-8, both as they are made.
    """
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )

    def one(doc, text: bytes):
        return [(doc, *digester(path).digest(text.decode("utf-8", "replace")))]

    schema = f"doc {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, schema, one, most=512)


def decode(encoded: DataFrame, path: str, *, words: bool = False) -> DataFrame:
    """``encoded`` with ``text`` instead of ``ids``.

    The tokenizer files here name no decoder, for which the library joins the
    tokens' names by spaces; ``words=True`` gives readable text instead.
    """
    fields = [f for f in encoded.schema.fields if f.name != "ids"]
    kept = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(bpe.load(path)) if words else Names(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = []
                for ids in batch.column(batch.num_columns - 1):
                    row = ids.as_py() or []
                    machine.reset()
                    texts.append(machine.decode(row) if words else machine.feed(row))
                columns = [batch.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*kept, "text"])

    return importable(encoded.select(*kept, "ids")).mapInArrow(run, f"{schema}, text string")
