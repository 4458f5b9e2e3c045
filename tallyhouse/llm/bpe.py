"""Byte-pair merges as automata.

A merge list decides locally whether two neighbouring tokens may stand beside
each other (:meth:`Merges.compatible`), and a sequence of tokens is the encoding
of its text exactly if all its neighbours may. So the last token of a prefix is
the one token that ends there and may follow the last token of what precedes it,
which makes encoding a left-to-right pass that never goes back over a text.

Symbols are characters: 0 to 255 are bytes, 256 to 511 the same bytes at the end
of a word.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from tokenizers import Regex, normalizers, pre_tokenizers

from tallyhouse.llm.tables import held

END_OF_WORD = "</w>"
#: Entries a memo may hold before it starts anew; a bound on memory, not on results.
MEMO = 200_000
#: Words of more symbols are encoded with a bounded window.
LONG_WORD = 512


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list of a tokenizer file, with their automata's memos."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = byte_characters()

        def symbols(token: str) -> str:
            ends = token.endswith(END_OF_WORD)
            text = "".join(chr(byte_of[c]) for c in (token[: -len(END_OF_WORD)] if ends else token))
            return text[:-1] + chr(ord(text[-1]) + 256) if ends else text

        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        self.ids = {symbols(t): i for t, i in model["vocab"].items() if t not in special}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = model["vocab"][left + right]
            pair = model["vocab"][left], model["vocab"][right]
            self.rank[whole], self.parts[whole], self.pairs[pair] = rank, pair, rank
        self.longest = max(map(len, self.ids))
        self.endings = {s[-n:] for s in self.ids for n in range(1, len(s) + 1)}
        self.prefixes = {s[:n] for s in self.ids for n in range(1, len(s))}
        self._memo: dict[tuple[int, int], bool] = {}

    @property
    def lookahead(self) -> int:
        """Symbols after which a token boundary can no longer change.

        Merges times the longest token: the bound proved for any proper merge
        list. The live window of :meth:`stream` converges far sooner; one that has
        not by then would mean that the merges are no proper list, and fails.
        """
        return len(self.parts) * self.longest

    def encode(self, word: str) -> list[int]:
        """Token ids of one word. A word within the window is settled at its end."""
        symbols = as_symbols(word)
        if len(symbols) >= 4 * self.longest:
            return list(self.stream(symbols))
        window: list[tuple[int, int]] = []
        for end in range(1, len(symbols) + 1):
            window.append(self._last(symbols, end, window, None))
        return self._path(window, len(symbols))

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both texts together is these two tokens.

        Merges are undone in the reverse of the order they were made. At each
        step one piece of ``left`` touches one of ``right``; had their own merge
        come before the merges that used them up, it would have crossed the
        boundary. Among equal ranks the leftmost goes first.
        """
        known = self._memo.get((left, right))
        if known is not None:
            return known
        x, y, x_used, y_used = left, right, len(self.parts), len(self.parts)
        while True:
            across = self.pairs.get((x, y))
            if across is not None and across < x_used and across <= y_used:
                fits = False
                break
            x_made, y_made = self.rank.get(x, -1), self.rank.get(y, -1)
            if x_made > y_made:
                x_used, x = x_made, self.parts[x][1]
            elif y_made >= 0:
                y_used, y = y_made, self.parts[y][0]
            else:
                fits = True
                break
        if len(self._memo) >= MEMO:
            self._memo.clear()
        self._memo[left, right] = fits
        return fits

    def stream(self, symbols: Iterator[str] | str) -> Iterator[int]:
        """Token ids of one word, each sent as soon as no later symbol can change it.

        Only prefixes that end within the longest token of the newest symbol can
        still be continued. Tokens on which the paths to all of these agree are
        final; they are sent and forgotten.
        """
        window: list[tuple[int, int]] = []  # per prefix: its last token, and its length
        text, sent = "", 0  # symbols since the last final boundary
        last_sent = None
        for symbol in symbols:
            text += symbol
            end = len(text)
            window.append(self._last(text, end, window, last_sent))
            if end >= 4 * self.longest:
                live = {end - n for n in range(self.longest) if end - n >= 0}
                while len(live) > 1:
                    far = max(live)
                    live.discard(far)
                    live.add(far - window[far - 1][1] if far else 0)
                final = live.pop()
                if final:
                    path = self._path(window, final)
                    yield from path
                    last_sent = path[-1]
                    sent += final
                    text, window = text[final:], window[final:]
                elif end > self.lookahead:
                    raise ValueError("the merges are not in the order they were made")
        if window:
            yield from self._path(window, len(window))

    def _last(self, text: str, end: int, window, before: int | None) -> tuple[int, int]:
        """The one token that ends a prefix and may follow what precedes it."""
        ids, endings, memo = self.ids, self.endings, self._memo
        for start in range(end - 1, -1, -1):
            piece = text[start:end]
            if piece not in endings:
                break
            if piece in ids:
                token, left = ids[piece], window[start - 1][0] if start else before
                if left is None:
                    return token, end - start
                fits = memo.get((left, token))
                if fits or (fits is None and self.compatible(left, token)):
                    return token, end - start
        raise ValueError(f"no token ends at {text[:end]!r}")

    @staticmethod
    def _path(window, end: int) -> list[int]:
        path = []
        while end > 0:
            token, length = window[end - 1]
            path.append(token)
            end -= length
        return path[::-1]


class Counter:
    """The merges as a deterministic transducer that counts tokens.

    A state is what later symbols can still depend on: for each prefix whose rest
    begins some token, that rest, the prefix's last token and its token count
    relative to the newest prefix. Transitions carry the change of the count; one
    that reads an end-of-word symbol leads back to the start. States and
    transitions are compiled when first taken.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        start = (("", None, 0),)
        self.states = [start]
        self.numbers = {start: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def count(self, word: str) -> int:
        """Tokens of one word, given as symbols."""
        if len(self.states) >= MEMO:
            self._reset()
        state = total = 0
        for symbol in word:
            step = self.steps[state].get(symbol)
            if step is None:
                step = self._compile(state, symbol)
            state, change = step
            total += change
        return total

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        merges, open_ = self.merges, []
        token = change = None
        for rest, last, count in self.states[state]:
            rest += symbol
            found = merges.ids.get(rest)
            if token is None and found is not None and (last is None or merges.compatible(last, found)):
                token, change = found, count + 1
            if rest in merges.prefixes:
                open_.append((rest, last, count))
        if ord(symbol) >= 256:
            number = 0
        else:
            key = (*((r, t, n - change) for r, t, n in open_), ("", token, 0))
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.states)
                self.states.append(key)
                self.steps.append({})
        self.steps[state][symbol] = number, change
        return number, change




def words_by(letter: str, digit: str, other: str) -> regex.Pattern:
    """How the tokenizer cuts a text into words; the alternatives are fixed values."""
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|{other}+")


WORDS = words_by(r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]")


@lru_cache(maxsize=1)
def late() -> frozenset[str]:
    """Letters and digits that Python's own Unicode tables do not know yet."""
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = regex.findall(r"[\p{L}\p{N}]", known)
    return frozenset(c for c in found if unicodedata.category(c) == "Cn")


@lru_cache(maxsize=1)
def late_words() -> regex.Pattern:
    """The words of texts that hold late ones: they count as what the tokenizer's
    Unicode tables, asked here, say they are."""
    text = "".join(sorted(late()))

    def some(kind: str) -> str:
        cut = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        return "".join(piece for piece, _ in cut.pre_tokenize_str(text))

    letters, digits = some(r"\p{L}"), some(r"\p{N}")
    neither = "".join(late() - set(letters) - set(digits))
    but = f"--[{neither}]" if neither else ""
    also = f"||[{neither}]" if neither else ""
    return words_by(
        rf"[\p{{L}}{but}]", rf"[\p{{N}}{but}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]{also}]"
    )


def words(text: str) -> list[str]:
    """Words of a section, lower-cased."""
    if text.isascii() or late().isdisjoint(text):
        return WORDS.findall(lowered(text))
    small = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return late_words().findall(small.normalize_str(text))


def lowered(text: str) -> str:
    """NFC, then lower case character by character: sigma ignores its place."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def as_symbols(word: str) -> str:
    text = word.encode("utf-8").decode("latin-1")
    return text[:-1] + chr(ord(text[-1]) + 256)


def sections(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """Plain texts (with None) and special tokens (with their ids), in order."""
    if not any(s in text for s in special):
        yield text, None
        return
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
    for part in cut.split(text):
        if part:
            yield part, special.get(part)


@held
def load(path: str) -> Merges:
    """One per Python worker and file."""
    return Merges(path)


@held
def counter(path: str) -> Counter:
    return Counter(load(path))
