"""BPE by a streaming transducer with bounded lookahead (operator 13).

A merge list decides how far to the right a token depends on its text: the sufficient lookahead, computed once from the
list. A word is read from left to right, a token is emitted as soon as its end lies that far behind the last symbol, and
what is held is never longer than the lookahead and one step. Texts are cut into pieces for cleaning and splitting, so
that no state follows the length of a text or of a word. Decoding is a state machine from bytes to text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm.common import bounded_batches, table, tidy

MODEL = public_tokenizers.path("word_bpe_49k.json")
#: Characters that are cleaned and split at once, symbols that a long word gathers between two emissions, characters from
#: which a word that a piece ends in is streamed, words whose ids a worker remembers, words that are looked up and ids that
#: are decoded at once.
PIECE, STEP, LONG, KNOWN, WORDS, IDS = 1 << 16, 4096, 64, 1 << 18, 1 << 17, 1 << 16
#: Bytes up to which a model file is sent to all workers.
MODEL_BYTES = 64 << 20

# The cleaning and the split that the model file states; white space as the split means it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


FAR = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(2)
def classes(most: int) -> tuple[str, str]:
    """Letters and numbers up to a code point as ranges of a character class."""
    out: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(most + 1):
        spans = out.get(unicodedata.category(chr(c))[0])
        if spans is not None:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out[k]) for k in "LN")
    return letters, numbers


@lru_cache(1)
def composing() -> frozenset[str]:
    """Characters that may join the one before them, besides those with a combining class."""
    second = {unicodedata.decomposition(chr(c)).split()[-1] for c in range(sys.maxunicode + 1) if re.fullmatch(r"[0-9A-F]+ [0-9A-F]+", unicodedata.decomposition(chr(c)))}
    return frozenset(chr(int(x, 16)) for x in second) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], suffix: str) -> int:
    """Symbols behind the end of a token that decide it at most.

    Let two texts agree up to a place p. The rules are applied in order; left of a frontier, first p, both have the same
    tokens. A rule (u, v) moves the frontier only if u ends at it, and by the length of u. The next rule to move it needs
    as its v a token that starts at the new frontier: one that begins with u or with uv. So the frontier moves by the sum
    of the lengths of u along a chain of rules at most, and the longest chain is found in the order of the rules.
    """
    far: dict[str, int] = {}
    most = 0
    for u, v in merges:
        n = len(u.removesuffix(suffix)) + max((far.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
        for t in (u, u + v):
            far[t] = max(far.get(t, 0), n)
        most = max(most, n)
    return most


class Model:
    """A model file: BPE over bytes with a suffix at the end of words, each token made by one rule at most, and each rule
    later than those of its parts. Anything else is an error, since the lookahead is proved for these only."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        bpe, added = spec["model"], spec["added_tokens"]
        self.suffix = bpe["end_of_word_suffix"] or ""
        split, by_byte = spec["pre_tokenizer"]["pretokenizers"]
        same = spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS} and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"]
        plain = bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and self.suffix
        if not same or not plain or by_byte["type"] != "ByteLevel" or by_byte["add_prefix_space"] or by_byte["use_regex"] or spec["decoder"] or spec["post_processor"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("a model of another kind")
        self.vocab: dict[str, int] = bpe["vocab"]
        merges = [tuple(m) for m in bpe["merges"]]
        born = {letter + end: -1 for letter in byte_letters() for end in ("", self.suffix)}
        for k, (u, v) in enumerate(merges):
            if u + v in born or u not in born or v not in born:
                raise ValueError(f"rule {k} isn't proper")
            born[u + v] = k
        self.lookahead = lookahead(merges, self.suffix)
        self.size = max(*self.vocab.values(), *(t["id"] for t in added)) + 1
        self.rules = {self.vocab[u] * self.size + self.vocab[v]: k for k, (u, v) in enumerate(merges)}
        self.made = [self.vocab[u + v] for u, v in merges]
        self.first = [self.vocab[c] for c in byte_letters()]
        self.last = [self.vocab[c + self.suffix] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens: list[str] = [""] * self.size
        for t, i in chain(self.vocab.items(), self.special.items()):
            self.tokens[i] = t
        self.length = [len(t.removesuffix(self.suffix)) for t in self.tokens]
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else re.compile(r"(?!)")
        self.ascii_words, _ = self._split("a-z", "0-9", "\\t-\\r ")
        self.near_words, _ = self._split(*classes(0xFFFF), SPACE)
        self.words, rest = self._split(*classes(sys.maxunicode), SPACE)
        self.runs = re.compile(f"[{classes(sys.maxunicode)[0]}]*"), re.compile(f"{rest}*")
        self.normalizer = Tokenizer.from_str(file.decode()).normalizer
        self.pairs = np.array(sorted(self.rules), np.int64)
        self.pair_rank = np.array([self.rules[int(p)] for p in self.pairs], np.int32)
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _split(letters: str, numbers: str, space: str) -> tuple[re.Pattern, str]:
        """The split over these classes, and the class of all else."""
        rest = f"[^{space}{letters}{numbers}]"
        return re.compile(SPLIT.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]").replace("[^\\s\\p{L}\\p{N}]", rest)), rest

    def merged(self, ids: list[int]) -> list[int]:
        """The merges of a list of symbols: always the first rule that applies, at its leftmost place."""
        rule, made, size, none = self.rules.get, self.made, self.size, len(self.made)
        if len(ids) <= LONG:
            open_ = [rule(a * size + b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
            while open_ and (k := min(open_)) < none:
                i = open_.index(k)
                ids[i] = new = made[k]
                del ids[i + 1], open_[i]
                if i < len(open_):
                    open_[i] = rule(new * size + ids[i + 1], none)
                if i:
                    open_[i - 1] = rule(ids[i - 1] * size + new, none)
            return ids
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(k, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (k := rule(a * size + b, none)) < none]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made[k], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := rule(ids[x] * size + ids[y], none)) < none:
                    heapq.heappush(heap, (k, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if len(raw) > self.lookahead:
            t = Transducer(self)
            return (*t.feed(raw), *t.end())
        ids = list(map(self.first.__getitem__, raw))
        ids[-1] = self.last[raw[-1]]
        return tuple(self.merged(ids))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rules of pairs, or len(made)."""
        pair = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], np.int32(len(self.made)))

    def learn(self, words: set[str]) -> None:
        """Makes words known, all at once: each round applies in each word the first rule that applies, at its leftmost
        place. Forgets all others if more than KNOWN would be known."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = words
        self.known.update((w, self.word(w)) for w in new if len(w) > LONG)
        if not (short := [w for w in new if len(w) <= LONG]):
            return
        raws = [w.encode() for w in short]
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        flat, ends, none = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(n), len(self.made)
        ids = np.array(self.first, np.int32)[flat]
        ids[ends - 1] = np.array(self.last, np.int32)[flat[ends - 1]]
        made, word = np.array(self.made, np.int32), np.repeat(np.arange(len(raws)), n)
        rank = np.append(self._ranks(ids[:-1], ids[1:]), np.int32(none))
        rank[ends - 1] = none
        done_ids, done_words = [], []
        while len(ids):
            begins = np.append(True, word[1:] != word[:-1])
            least = np.minimum.reduceat(rank, np.flatnonzero(begins))
            seg = np.cumsum(begins) - 1
            over = (least == none)[seg]
            done_ids.append(ids[over])
            done_words.append(word[over])
            ids, word, rank, least = ids[~over], word[~over], rank[~over], least[least < none]
            begins = begins[~over]
            hit = np.flatnonzero(rank == least[np.cumsum(begins) - 1])
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])] if len(hit) else hit
            ids[hit] = made[least]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            ids, word, rank = ids[stays], word[stays], rank[stays]
            at = hit - np.arange(len(hit))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                rank[left] = np.where((word[left] == word[right]) & (left < right), self._ranks(ids[left], ids[right]), none)
        found, which = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(which, kind="stable")
        found, ends = found[order].tolist(), np.cumsum(np.bincount(which, minlength=len(short))).tolist()
        self.known.update((w, tuple(found[a:b])) for w, a, b in zip(short, [0, *ends], ends))  # noqa: B905

    def words_of(self, s: str) -> list[str]:
        """The words of a cleaned text; the narrower classes are faster."""
        far = None if s.isascii() else FAR.search(s)
        return (self.ascii_words if s.isascii() else self.words if far else self.near_words).findall(s)

    def cleaned(self, piece: str) -> str:
        """Composed and in small letters, character by character; white space stays, since it only separates."""
        if piece.isascii():
            return piece.lower()
        if re.search("[ⰯꟀ-ꟿ\U00010000-\U0010ffff]", piece):  # letters that are younger than some tables
            return self.normalizer.normalize_str(piece)
        return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def parts(self, text: str, piece: int = PIECE) -> Iterator[list[str] | tuple[int, ...]]:
        """A text from left to right: lists of words, or ids of a special token or of a part of a long word."""
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                yield (self.special[part],)
            elif part:
                yield from self._section(part, piece)

    def _section(self, text: str, size: int) -> Iterator[list[str] | tuple[int, ...]]:
        word, run, held = None, None, ""
        for piece, whole in pieces(text, size):
            s = held + self.cleaned(piece)
            held = ""
            if word:
                more = run.match(s).end()
                yield tuple(word.feed(s[:more].encode()))
                if more == len(s) and not whole:
                    continue
                yield tuple(word.end())
                word, s = None, s[more:]
            words = self.words_of(s)
            if not whole:
                if words and len(words[-1]) > LONG and s.endswith(words[-1]):
                    run = self.runs[not words[-1][0].isalpha()]
                    word, tail = Transducer(self), words.pop()
                    yield words
                    yield tuple(word.feed(tail.encode()))
                    continue
                # The split of the last three words may depend on what follows them.
                starts = [m.start() for m in self.words.finditer(s)][-3:]
                held, words = (s[starts[0] :], words[: -len(starts)]) if starts else ("", words)
            yield words
        if word:
            yield tuple(word.end())

    def ids(self, texts: Iterable[str], piece: int = PIECE) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids) for parts of texts, in order; what is held doesn't grow with the texts."""
        held, n = [], 0
        for k, text in enumerate(texts):
            for part in self.parts(text, piece):
                held.append((k, part))
                n += len(part)
                if n >= WORDS:
                    yield from self._known(held)
                    held, n = [], 0
        yield from self._known(held)

    def _known(self, parts: list[tuple[int, list[str] | tuple[int, ...]]]) -> Iterator[tuple[int, list[int]]]:
        self.learn(set().union(*(p for _, p in parts if isinstance(p, list))))
        for k, p in parts:
            yield k, list(chain.from_iterable(map(self.known.__getitem__, p)) if isinstance(p, list) else p)


def pieces(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """text in pieces of about size characters, which can be cleaned one by one; whether a piece ends where a word does."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while at > start and text[at] not in " \t\n\r\v\f":
            at -= 1
        if whole := at > start:
            yield text[start:at], True
        else:
            at = start + size
            while at < len(text) and (unicodedata.combining(text[at]) or text[at] in composing()):
                at += 1
            yield text[start:at], False
        start = at
    yield text[start:], True


class Transducer:
    """The ids of one word, which arrives in parts; holds lookahead + STEP symbols at most."""

    def __init__(self, model: Model, step: int = STEP):
        self.model, self.step, self.held = model, step, bytearray()

    def feed(self, raw: bytes) -> Iterator[int]:
        """Takes a part of the word and emits the tokens that are stable now. The last byte isn't judged yet, as it may
        be the word's last."""
        most = self.model.lookahead + self.step
        for k in range(0, len(raw), self.step):
            self.held += raw[k : k + self.step]
            if len(self.held) > most:
                stable, end = len(self.held) - 1 - self.model.lookahead, 0
                for t in self.model.merged([self.model.first[b] for b in self.held[:-1]]):
                    if end + self.model.length[t] > stable:
                        break
                    end += self.model.length[t]
                    yield t
                del self.held[:end]

    def end(self) -> list[int]:
        ids = [self.model.first[b] for b in self.held]
        if ids:
            ids[-1] = self.model.last[self.held[-1]]
        self.held.clear()
        return self.model.merged(ids)


class TextMachine:
    """Ids to text, part by part: each id adds its bytes, and whole characters leave as soon as they are there. Bytes that
    are no UTF-8 become U+FFFD. Between two ids stands sep."""

    def __init__(self, table: list[bytes], sep: bytes):
        self.table, self.sep, self.begun = table, sep, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        raw = self.sep.join(map(self.table.__getitem__, ids))
        if ids:
            raw, self.begun = (self.sep if self.begun else b"") + raw, True
        return self.machine.decode(raw)

    def end(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(2)
def model_file(path: str) -> bytes:
    """The model file; the driver reads it, workers get it with the task."""
    with open(path, "rb") as f:
        out = f.read(MODEL_BYTES + 1)
    if len(out) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return out


@lru_cache(2)
def model(file: bytes) -> Model:
    return Model(file)


def machine(m: Model, plain: bool) -> TextMachine:
    """plain: the text itself, a space after each word; else the tokens as the library joins them."""
    if not plain:
        return TextMachine([t.encode() for t in m.tokens], b" ")
    byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    spelt = [t.encode() if t in m.special else b"".join(byte[c] for c in t.removesuffix(m.suffix)) + b" " * t.endswith(m.suffix) for t in m.tokens]
    return TextMachine(spelt, b"")


@tidy
def _encode(batches: Iterator[pa.RecordBatch], file: bytes, piece: int) -> Iterator[pa.RecordBatch]:
    m = model(file)
    for batch in batches:
        n, parts = np.zeros(batch.num_rows + 1, np.int64), [pa.array([], pa.int32())]
        for k, ids in m.ids((t or "" for t in batch.column("text").to_pylist()), piece):
            n[k + 1] += len(ids)
            parts.append(pa.array(ids, pa.int32()))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n).astype(np.int32)), pa.concat_arrays(parts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, special tokens only where the text spells them.

    One row per row of docs, without a shuffle; a null or empty text has no ids; ids of rows may be null or repeat; other
    columns don't matter; no rows give no rows. A model file that isn't of the kind described in Model is an error.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, file=model_file(path), piece=piece), "doc_id long, ids array<int>")


@tidy
def _decode(batches: Iterator[pa.RecordBatch], file: bytes, plain: bool) -> Iterator[pa.RecordBatch]:
    made = machine(model(file), plain)
    for batch in batches:
        texts = []
        for ids in batch.column("ids").to_pylist():
            m = TextMachine(made.table, made.sep)
            texts.append("".join([*(m.feed(ids[k : k + IDS]) for k in range(0, len(ids or ()), IDS)), m.end()]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def decode(encoded: DataFrame, path: str = MODEL, plain: bool = False) -> DataFrame:
    """encoded(doc_id, ids) with text: the tokens joined by spaces, as the library does for a model without a decoder, or,
    if plain, the words that were encoded, a space after each. Null ids are none; an id that isn't there is an error."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, file=model_file(path), plain=plain), "doc_id long, ids array<int>, text string")


@tidy
def _digests(batches: Iterator[pa.RecordBatch], file: bytes) -> Iterator[pa.RecordBatch]:
    m = model(file)
    made, decimal = machine(m, False), [str(i) for i in range(m.size)]
    for batch in batches:
        n, hashes = [], []
        for x in batch.column("ids"):
            ids = x.values if x.is_valid else pa.array([], pa.int32())
            spelt, text, decoder = hashlib.sha256(), hashlib.sha256(), TextMachine(made.table, made.sep)
            for k in range(0, len(ids), IDS):
                part = ids[k : k + IDS].to_pylist()
                spelt.update((" " * (k > 0) + " ".join(map(decimal.__getitem__, part))).encode())
                text.update(decoder.feed(part).encode())
            text.update(decoder.end().encode())
            n.append(len(ids))
            hashes.append((spelt.hexdigest(), text.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([h[k] for h in hashes], pa.string()) for k in (0, 1))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded(doc_id, ids): decode()'s text, hashed as it leaves the machine."""
    bounded_batches(encoded.sparkSession)
    return encoded.mapInArrow(partial(_digests, file=model_file(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
