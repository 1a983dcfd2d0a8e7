"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's greedy longest token matches come from an Aho-Corasick automaton over
the vocabulary.  A match is taken only if it is compatible with the token before
it: merging the two tokens' texts must give those two tokens again.  Otherwise
the encoder backs off to the next shorter token that starts there, or drops the
last token.  Compatibility is looked up in a table filled on demand from the
merge ranks, and dead positions are remembered, so a word takes linear time.

Decoding joins slices of one string that holds every token's text; an offset
table says where each begins.

Workers remember the encodings of words; the memory is bounded by ``REMEMBERED``
entries.  Texts in Latin-1 are split by one pattern, others by the library's own
normaliser and splitter.

Nulls: a null text is empty and has no tokens; repeated rows are rows of their
own; a null doc_id is allowed and an empty table gives no rows.  Special tokens
inside a text are ids, as in the tokenizers library.  Texts of any length are
encoded whole, word by word; of overlapping matches the longest wins, so nothing
ties.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame

REMEMBERED = 240_000
#: Token pairs whose compatibility a worker remembers.
PAIRS = 200_000
#: Texts of a batch that are held as Python strings at a time.
SLICE = 256
#: Words longer than this are encoded but not remembered.
LONG_WORD = 64
#: The tokenizer's split pattern on lower-case Latin-1: contractions, letters, single numerals, other marks.
LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
#: Byte-level BPE writes a byte that is no visible Latin-1 character as the next character from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def byte_level(word: str) -> str:
    """A word with one character for each of its UTF-8 bytes."""
    return word.encode().decode("latin-1").translate(BYTE_CHARS)


class Encoder:
    """The word-end BPE of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        library = tokenizers.Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pretokenise = library.pre_tokenizer.pre_tokenize_str
        model = data["model"]
        self.end: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = {k: str(v) for k, v in added.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        texts = {i: t for t, i in (vocab | added).items()}
        self.size = max(texts) + 1
        self.offsets, pieces, at = [0], [], 0
        for i in range(self.size):
            pieces.append(texts.get(i, ""))
            at += len(pieces[-1])
            self.offsets.append(at)
        self.all_text = "".join(pieces)
        #: Each id as written, to its slice of the text and a blank.
        self.shown = {str(i): self.all_text[self.offsets[i] : self.offsets[i + 1]] + " " for i in texts}
        self._ranks(vocab, model["merges"])

    def _ranks(self, vocab: dict[str, int], merges: list) -> None:
        """Units are single characters; the word end counts as part of the last one and is one private character here."""
        self.mark = "\ue000"
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end) or t == self.end}
        self.ending = {t[: -len(self.end)]: i for t, i in vocab.items() if t.endswith(self.end) and t != self.end}
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(merges):
            left, right = m.split(" ") if isinstance(m, str) else m
            made = vocab[left + right]
            self.pair[vocab[left], vocab[right]] = (rank, made)
            self.parts.setdefault(made, (rank, vocab[left], vocab[right]))
        texts = {**self.inner, **{t + self.mark: i for t, i in self.ending.items()}}
        self.by_text = {t: i for t, i in texts.items() if len(t.rstrip(self.mark)) == 1 or i in self.parts}
        self.length = {i: len(t) for t, i in self.by_text.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.by_text.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {
            i: next((self.by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.by_text), None)
            for t, i in self.by_text.items()
        }
        self.compatible = lru_cache(maxsize=PAIRS)(self._compatible)
        self.spine = cache(self._spine)
        self.word = lru_cache(maxsize=REMEMBERED // 4)(self.encode_word)

    def merged(self, units: list[int]) -> list[int]:
        """The plain merge loop: the lowest rank first, the leftmost of equals."""
        units = list(units)
        while len(units) > 1:
            found = [(self.pair[p][0], i) for i, p in enumerate(zip(units, units[1:], strict=False)) if p in self.pair]
            if not found:
                break
            _, i = min(found)
            units[i : i + 2] = [self.pair[units[i], units[i + 1]][1]]
        return units

    def units(self, text: str) -> list[int]:
        """The single-character tokens of a text that may end with the mark."""
        if text.endswith(self.mark):
            return [*map(self.inner.__getitem__, text[:-2]), self.ending[text[-2]]]
        return [*map(self.inner.__getitem__, text)]

    def token_text(self, token: int) -> str:
        raw = self.all_text[self.offsets[token] : self.offsets[token + 1]]
        return raw[: -len(self.end)] + self.mark if raw.endswith(self.end) and raw != self.end else raw

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """(part, rank that made it, rank that used it up) along one edge of a token, whole token first."""
        out, used = [], float("inf")
        while token in self.parts:
            made = self.parts[token]
            out.append((token, made[0], used))
            token, used = made[side], made[0]
        return [*out, (token, -1, used)]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border of two tokens.

        The parts that touch the border are followed back in time; a merge of
        two of them fires if its rank comes while both are there, equal ranks
        from left to right.
        """
        ls, rs = self.spine(left, 2), self.spine(right, 1)
        i = j = 0
        while True:
            l_token, l_made, l_used = ls[i]
            r_token, r_made, r_used = rs[j]
            across = self.pair.get((l_token, r_token))
            if across is not None:
                when = max(across[0], l_made, r_made)
                if when < l_used and when <= r_used:
                    return False
            if l_made < 0 and r_made < 0:
                return True
            if r_made >= l_made:
                j += 1
            else:
                i += 1

    def longest(self, text: str, at: int) -> int | None:
        """The longest token that starts at ``at``."""
        stop, (size, token) = next(self.automaton.iter_long(text, at), (-1, (0, None)))
        return token if stop - size + 1 == at else None

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-tokenised word."""
        if not word:
            return []
        text = word + self.mark
        whole = self.by_text.get(text)
        if whole is not None and self.whole_is_exact(whole):
            return [whole]
        greedy = {stop - size + 1: token for stop, (size, token) in self.automaton.iter_long(text)}
        dead = bytearray(len(text) + 1)
        tokens: list[int] = []
        at, token = 0, greedy.get(0)
        while True:
            while token is not None:
                stop = at + self.length[token]
                splits = stop == len(text) - 1  # the mark belongs to the last character
                if not splits and not dead[stop] and (not tokens or self.compatible(tokens[-1], token)):
                    tokens.append(token)
                    at = stop
                    break
                token = self.shorter[token]
            else:
                dead[at] = 1
                if not tokens:
                    return self.merged(self.units(text))
                token = tokens.pop()
                at -= self.length[token]
                token = self.shorter[token]
                continue
            if at == len(text):
                return tokens
            token = greedy.get(at) or self.longest(text, at)

    @cache  # noqa: B019
    def whole_is_exact(self, token: int) -> bool:
        return self.merged(self.units(self.token_text(token))) == [token]

    def words(self, text: str) -> list[str] | None:
        """Lower-case words of a Latin-1 text, split as the tokenizer splits; None for any other text.

        In that range the normaliser only lowers letters and folds white space,
        so a plain pattern gives its words.
        """
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return LATIN_WORDS.findall(text.lower())

    def encode_plain(self, text: str) -> list[int]:
        words = self.words(text)
        if words is None:
            mapped = [w for w, _ in self.pretokenise(self.normalise(text))]
        else:
            mapped = [byte_level(w) for w in words]
        ids: list[int] = []
        for word in mapped:
            ids += self.word(word) if len(word) <= LONG_WORD else self.encode_word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        off, text = self.offsets, self.all_text
        return " ".join([text[off[i] : off[i + 1]] for i in ids])

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.splitter.split(text or "")):
            ids += [int(self.special[part])] if i % 2 else self.encode_plain(part)
        return ids


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def written(ids: list[int]) -> str:
    """Ids with a blank after each."""
    return "".join([f"{i} " for i in ids])


class _Memory(dict):
    """Word to its ids as written, computed when missing; two generations of half the bound each."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.older: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        found = self.older.get(word)
        if found is None:
            found = written(self.enc.encode_word(byte_level(word)))
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@cache
def _memory(path: str) -> _Memory:
    """Kept for as long as the worker lives, so later tasks find it filled."""
    return _Memory(encoder(path))


def digests(path: str, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
    """(n_tokens, sha256 of the ids, sha256 of the decoded text) of each text."""
    enc, look = encoder(path), _memory(path).__getitem__
    shown = enc.shown.__getitem__
    for text in texts:
        parts: list[str] = []
        for i, part in enumerate(enc.splitter.split(text or "")):
            if i % 2:
                parts.append(enc.special[part] + " ")
            else:
                words = enc.words(part)
                parts.append(written(enc.encode_plain(part)) if words is None else "".join(map(look, words)))
        ids = "".join(parts)
        decoded = "".join(map(shown, ids.split()))
        n = ids.count(" ")
        yield n, hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(decoded[:-1].encode()).hexdigest()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _batch(part.column(0), list(digests(path, part.column(1).to_pylist())))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, SLICE) for start in range(0, batch.num_rows, SLICE))


def _batch(ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*rows, strict=True)
    columns = [ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (part for whole in batches for part in _slices(whole)):
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): tokens' texts joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (part for whole in batches for part in _slices(whole)):
            texts = [enc.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
