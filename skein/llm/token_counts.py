"""Exact token counts of every prefix of a text, without encoding any prefix.

Byte-pair encoding has a property that makes this a dynamic program: a sequence of tokens is what the
encoder gives exactly if every two neighbours are, and so the last token of a prefix is the one suffix
of it that fits the last token of what lies before. Count and last token of each prefix follow from
those of shorter ones. Two tokens fit if no merge across their border comes before the merges that made
the symbols it would join; that is read off the merges of both, from the latest back.

The program runs over words of the tokenizer in hand (pieces between white space, then runs of letters,
single digits, runs of other signs, contractions), each closed by an end-of-word mark, and remembers the
counts of words that come often. Words new to a block of texts are taken in order, so that those which
begin alike share the columns of the program.

Counts are kept as one signed byte for each code point: how many tokens the prefix that ends there has
more than the one before. Sums over them answer what a prefix costs and where a budget ends. The longest
prefix within a budget need not be the first that reaches it: a longer prefix can have fewer tokens.
"""

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import documents, fresh, kept, pa_types, slices, small_batches, tokenizer_path

LIMIT = 2048
#: Words and pairs of tokens that a Python worker remembers, and characters of a block of texts.
WORDS, PAIRS, BLOCK = 400_000, 400_000, 1 << 20
#: What the tokenizer's own pattern takes for white space (fixed: Unicode's White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK, _SPLITS_ALIKE = re.compile(f"[^{SPACE}]+"), re.compile("[\x1c-\x1f]")
#: The contractions that are words of their own (fixed values of the tokenizer's pattern).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Letters whose lower case and normal form have a letter for a letter, and signs that are a word of their own after them.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
_NEVER = 1 << 60


class Merges:
    """The vocabulary as a table of merges, and which tokens fit side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.close = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self._merge, self._halves, self._rank = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self._merge[a << 20 | b], self._halves[whole], self._rank[whole] = rank, (a, b), rank
        #: Bare letters to (id within a word or -1, id at a word's end or -1); the longest by their last three letters (else two).
        self.tokens: dict[str, tuple[int, int]] = {}
        self.longest: dict[str, int] = {}
        for token, number in self.ids.items():
            ends = bool(self.close) and token.endswith(self.close) and token != self.close
            bare = token.removesuffix(self.close) if ends else token
            inner, final = self.tokens.get(bare, (-1, -1))
            self.tokens[bare] = (inner, number) if ends else (number, final if self.close else number)
            self.longest[bare[-3:]] = max(self.longest.get(bare[-3:], 2), len(bare))
        self.known: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoder leaves ``a`` before ``b`` as they are."""
        key = a << 20 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        merge, rank, halves = self._merge.get, self._rank.get, self._halves
        gone_a = gone_b = _NEVER  # when the symbols at the border were merged away within their own token
        while True:
            at = merge(a << 20 | b, _NEVER)
            if at < gone_a and at <= gone_b:  # of equal merges the left one is made first
                return False
            made_a, made_b = rank(a, -1), rank(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                gone_a, a = made_a, halves[a][1]
            else:
                gone_b, b = made_b, halves[b][0]


class Word:
    """The columns of the program over one word.

    For each prefix in letters (bytes): tokens and last token if the word goes on, and tokens if it ends there.
    """

    def __init__(self, merges: Merges):
        self._m, self.letters, self._n, self._last, self._ended = merges, "", [0], [-1], [0]

    def cut(self, size: int) -> None:
        self.letters = self.letters[:size]
        del self._n[size + 1 :], self._last[size + 1 :], self._ended[size + 1 :]

    def push(self, letters: str) -> None:
        tokens, longest, fits, known = self._m.tokens.get, self._m.longest.get, self._m.fits, self._m.known.get
        n, last, ended = self._n, self._last, self._ended
        at = len(self.letters)
        s = self.letters = self.letters + letters
        for i in range(at + 1, len(s) + 1):
            within = whole = -1
            for k in range(min(i, longest(s[i - 3 : i], 2)) if i > 2 else i, 0, -1):
                found = tokens(s[i - k : i])
                if found is None:
                    continue
                before = last[i - k]
                if within < 0 <= found[0] and (k == i or k == 1 or (fits(before, found[0]) if (x := known(before << 20 | found[0])) is None else x)):
                    within, count = found[0], n[i - k] + 1
                if whole < 0 <= found[1] and (k == i or k == 1 or (fits(before, found[1]) if (x := known(before << 20 | found[1])) is None else x)):
                    whole, total = found[1], n[i - k] + 1
                if within >= 0 and whole >= 0:
                    break
            n.append(count)
            last.append(within)
            ended.append(total)

    def count(self) -> int:
        """Tokens of the word if it ends here."""
        return self._ended[-1]

    def ended(self) -> list[int]:
        """Tokens of each prefix, the empty one first, if the word ended there."""
        return self._ended


class PrefixCounter:
    """Token counts of all prefixes for a tokenizer whose words end in a mark and whose text is lower-cased."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._names = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._named = re.compile("|".join(map(re.escape, self._names))) if self._names else None
        self._merges = Merges(path)
        self._byte = _letters()
        self._leads = {self._byte[b] for b in range(0xC0, 0xF5)}  # first bytes of longer code points
        self._word = Word(self._merges)
        self._memo: dict[str, bytes] = {}
        self._kinds: dict[str, str] = {}
        self._forms: dict[str, str] = {}
        self._runs: dict[str, bytes] = {}

    def _kind(self, c: str) -> str:
        """L (letter), N (number), P (other) or "" (white space), as the tokenizer's own pattern says."""
        found = self._kinds.get(c)
        if found is None:
            split = self._library.pre_tokenizer.pre_tokenize_str
            found = "" if not split(c) else "L" if len(split("a" + c)) == 1 else "P" if len(split("!" + c)) == 1 else "N"
            self._kinds[c] = found
        return found

    def _form(self, text: str) -> str:
        if len(text) > 1:
            return self._library.normalizer.normalize_str(text)
        found = self._forms.get(text)
        if found is None:
            found = self._forms[text] = self._library.normalizer.normalize_str(text)
        return found

    def _plain(self, stems: set[str]) -> dict[str, bytes]:
        """Increments for lower-case words of the letters in PLAIN."""
        word, before, out = self._word, "", {}
        word.cut(0)
        for stem in sorted(stems):
            letters = stem if stem.isascii() else "".join(self._byte[b] for b in stem.encode())
            k, most = 0, min(len(before), len(letters))
            while k < most and before[k] == letters[k]:
                k += 1
            word.cut(k)
            word.push(letters[k:])
            before, counts = letters, word.ended()
            if letters is not stem:
                counts = [n for n, c in zip(counts[1:], letters) if c not in self._leads]
                counts.insert(0, 0)
            out[stem] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
        word.cut(0)
        return out

    def _any(self, chunk: str) -> list[int]:
        """Counts of the prefixes of a chunk without white space, special tokens apart."""
        state, counts = _Pieces(self), []
        if unicodedata.is_normalized("NFC", chunk):
            for c in chunk:
                state.feed(self._form(c))
                counts.append(state.count())
            return counts
        at = 0
        while at < len(chunk):
            end = at + 1
            while end < len(chunk) and not _starts(chunk[end]):
                end += 1
            saved = state.save()
            for k in range(at + 1, end + 1):
                state.load(saved)
                state.feed(self._form(chunk[at:k]))
                counts.append(state.count())
            at = end
        return counts

    def _increments(self, chunk: str) -> bytes:
        if not self._named or not (spots := list(self._named.finditer(chunk))):
            counts = self._any(chunk)
        else:  # what lies before a special token, then the token as ordinary text until it is whole
            counts, done, at = [], 0, 0
            for m in spots:
                part = self._any(chunk[at : m.end()])
                before = part[m.start() - at - 1] if m.start() > at else 0
                counts += [done + n for n in part[:-1]] + [done + before + 1]
                done, at = done + before + 1, m.end()
            counts += [done + n for n in self._any(chunk[at:])]
        return np.diff(np.array([0, *counts])).astype(np.int8).tobytes()

    def _signs(self, run: str) -> bytes:
        if len(run) > 9:
            return self._increments(run)
        if run not in self._runs:
            if len(self._runs) >= WORDS // 10:
                self._runs.clear()
            self._runs[run] = self._increments(run) if run else b""
        return self._runs[run]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Increments for chunks that are not remembered; some of them are from now on."""
        out, stems = {}, {}
        new = sorted(chunks.difference(self._memo))
        for c in new:
            if m := PLAIN.fullmatch(c):
                stems[c] = m.group(1).lower(), self._signs(m.group(2))
            else:
                out[c] = self._increments(c)
        plain = self._plain({stem for stem, _ in stems.values()})
        for c, (stem, mark) in stems.items():
            out[c] = plain[stem] + mark
        room = WORDS - len(self._memo)
        if room > 0:
            self._memo.update((c, out[c]) for c in new[: room] if len(c) < 40)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = [split(t) for t in texts]
        held = self._held(set().union(*cut))
        return [int(np.frombuffer(b"".join(map(held, words)), np.int8).sum(dtype=np.int64)) for words in cut]

    def prefixes(self, text: str) -> bytes:
        """The increments over all of ``text``; white space adds none."""
        spots = list(_CHUNK.finditer(text))
        held = self._held({m.group() for m in spots})
        out, at = [], 0
        for m in spots:
            out += (bytes(m.start() - at), held(m.group()))
            at = m.end()
        return b"".join([*out, bytes(len(text) - at)])

    def _held(self, chunks: set[str]):
        memo, fresh_ = self._memo, self.learn(chunks)
        return lambda c: fresh_.get(c) or memo[c]


class _Pieces:
    """The tokenizer's words within a chunk, letter by letter of the normalised text."""

    def __init__(self, counter: PrefixCounter):
        self._c, self._done, self._kind, self._shape, self._word = counter, 0, "", "", Word(counter._merges)

    def save(self) -> tuple:
        return self._done, self._kind, self._shape, self._word, len(self._word.letters)

    def load(self, saved: tuple) -> None:
        self._done, self._kind, self._shape, self._word, size = saved
        self._word.cut(size)

    def count(self) -> int:
        return self._done + self._word.count()

    def _open(self, kind: str) -> None:
        self._done, self._kind, self._word = self.count(), kind, Word(self._c._merges)

    def feed(self, text: str) -> None:
        for c in text:
            shape = self._shape + c  # an apostrophe that begins a word, and the letter after it
            if shape in CONTRACTIONS:
                before = self._before if len(shape) == 3 else self._done
                self._done, self._kind, self._shape, self._word = before, "'", "", Word(self._c._merges)
                self._push(shape)
                continue
            kind = self._c._kind(c)
            if not kind:
                continue
            if shape in ("'r", "'v", "'l"):
                self._before, self._shape = self._done, shape
            else:
                self._shape = ""
            if kind != self._kind or kind == "N":
                self._open(kind)
                if c == "'":
                    self._shape = c
            self._push(c)

    def _push(self, text: str) -> None:
        self._word.push("".join(self._c._byte[b] for b in text.encode()))


def _letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


def _starts(c: str) -> bool:
    """Whether normalisation never joins ``c`` to what lies before it."""
    return unicodedata.category(c)[0] in "LNPSZC" and not 0x1160 <= ord(c) <= 0x11FF and not 0x16D63 <= ord(c) <= 0x16D6A and unicodedata.combining(c) == 0


def split(text: str) -> list[str]:
    """The chunks of ``text`` between white space."""
    return _CHUNK.findall(text) if _SPLITS_ALIKE.search(text) else text.split()


def _blocks(text: str) -> Iterator[str]:
    """``text`` in stretches of some BLOCK characters that end at white space."""
    at = 0
    while len(text) - at > BLOCK:
        space = re.compile(f"[{SPACE}]").search(text, at + BLOCK)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def counter(path: str) -> PrefixCounter:
    """This Python worker's counter for ``path``."""
    return kept(f"prefix counts {path}", lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, store: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and, if ``store``, ``prefixes``: a signed byte for each code point.

    A prefix's tokens are the sum of the bytes up to its end (see ``tokens_at`` and ``longest_within``),
    exactly what the library gives for that prefix by itself. A null or empty text has no token and no
    byte. Repeated rows are counted alike. An empty table stays empty. A long text goes in
    blocks that end at white space, beside which only its counts are kept. Columns named as those given
    here give way.
    """
    adds = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), *[StructField("prefixes", BinaryType())] * store]
    names = {f.name for f in adds}
    small_batches(docs.sparkSession)
    passed = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    (raw,) = fresh(docs, "_raw")
    source = docs.select(*[F.col(f"`{c}`") for c in passed], F.col(text).alias(raw))
    kinds = pa_types(StructType(adds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, len(passed)):
                texts = [t or "" for t in part.column(len(passed)).to_pylist()]
                new = [[len(t.encode()) for t in texts]]
                if store:
                    held = [b"".join(map(count.prefixes, _blocks(t))) for t in texts]
                    new += [[int(np.frombuffer(p, np.int8).sum(dtype=np.int64)) for p in held], held]
                elif sum(map(len, texts)) > 4 * BLOCK:
                    new.append([sum(count.counts([b])[0] for b in _blocks(t)) for t in texts])
                else:
                    new.append(count.counts(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(passed)], *[pa.array(v, k) for v, k in zip(new, kinds)]], names=[*passed, *[f.name for f in adds]])

    return source.mapInArrow(run, StructType([*source.schema.fields[: len(passed)], *adds]))


@F.pandas_udf(LongType())
def tokens_at(prefixes: pd.Series, ends: pd.Series) -> pd.Series:
    """Tokens of the first ``ends`` code points (all, if the text is shorter; null stays null)."""
    return pd.Series([None if p is None or pd.isna(e) else int(np.frombuffer(p, np.int8)[: max(int(e), 0)].sum(dtype=np.int64)) for p, e in zip(prefixes, ends)], dtype="Int64")


@F.pandas_udf(LongType())
def longest_within(prefixes: pd.Series, budgets: pd.Series) -> pd.Series:
    """Code points of the longest prefix of at most ``budgets`` tokens (null stays null; below zero: null)."""
    out = []
    for p, most in zip(prefixes, budgets):
        if p is None or pd.isna(most) or most < 0:
            out.append(None)
            continue
        fits = np.flatnonzero(np.cumsum(np.frombuffer(p, np.int8), dtype=np.int64) <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="Int64")


def truncated(counted: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """``counted`` with ``text`` cut to the longest prefix of at most ``budget`` tokens, from its stored prefixes.

    Null texts stay null. Nothing is encoded again.
    """
    return counted.withColumn(text, F.substring(F.col(text), F.lit(1), longest_within(F.col("prefixes"), F.lit(budget)).cast("int")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they pass the limit."""
    found = count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), keep=["doc_id"], store=False)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
