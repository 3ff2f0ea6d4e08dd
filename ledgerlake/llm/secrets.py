"""Secret scans by grammar inference (operator 3).

Fixed patterns find credentials of three kinds. The distinct credentials are labelled examples: of each kind's a bounded
sample makes a prefix tree, whose statistically compatible states are merged into a probabilistic automaton. All ordinary
tokens, as often as they occur, make a background automaton in the same way. The trees are counted in Spark; once states
are merged, all whole strings are counted again on their way through them. What then looks more like a credential leaves
the background, which is inferred once more. Then every token of every text that no base span covers whole is scored by
its likelihood under each format against the background, and what is far more likely a credential is added.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_batches, staged, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The same matches as of shorter patterns that are filtered by length: runs are whole.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_LEAST = 8
#: Every whole run over the credential alphabet from the least length of any kind.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % ASSIGN_LEAST)
#: Examples of each kind that automata are inferred from: those of least hash.
EXAMPLES = 1500
#: Significance of the test that keeps states apart; longest prefix that has a state of its own in the tree.
ALPHA, DEPTH = 0.01, 128
#: Visits below which the test can't tell a prefix from any other, so that it needs no state in the tree.
SEEN = math.floor(0.5 * math.log(2 / ALPHA)) + 1
#: Prefixes of less than a FINE-th of a kind's strings share the states of others; it bounds the tree at each depth.
FINE = 20_000
#: Share of the ordinary tokens up to which those that look like credentials are left out of the background.
HIDDEN = 0.1
#: Distinct strings that a task counts before it hands them on; tokens whose kind a task remembers.
TALLY, MEMO = 200_000, 200_000
#: A candidate is added when its likelihood is MARGIN nats above the background's and its mean per character at least
#: that of all but SLACK of the kind's examples.
MARGIN, SLACK = 25.0, 0.01
#: Character classes, which are the automata's symbols; END closes a string.
SYMBOLS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
END = len(SYMBOLS)
SYMBOL = {c: k for k, group in enumerate(SYMBOLS) for c in group}
SIZE_LOG = tuple(math.log(len(g)) for g in SYMBOLS)
#: A token as one letter for each symbol.
LETTERS = "abcdefghijklmnopqrstuvwxyz"[:END]
SPELL = str.maketrans({c: LETTERS[k] for c, k in SYMBOL.items()})


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of what the fixed patterns find: leftmost, non-overlapping by kind, code points."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


class Automaton:
    """States with counts of symbols and one successor for each; inferred by merging states of a prefix tree."""

    def __init__(self, strings: list[str]):
        spelled = [s.translate(SPELL) for s in strings]
        seen: dict[str, list[int]] = {"": [0] * (END + 1)}
        for s in spelled:
            for i in range(min(len(s), DEPTH) + 1):
                seen.setdefault(s[:i], [0] * (END + 1))[LETTERS.index(s[i]) if i < len(s) else END] += 1
        self._grow(seen)
        self.recount(_walk_counts(Counter(spelled).items(), self.next))

    @classmethod
    def of_prefixes(cls, seen: dict[str, list[int]]) -> Automaton:
        """seen: of each prefix of the tree, how often each symbol follows and how often a string ends there."""
        new = cls.__new__(cls)
        new._grow(seen)
        return new

    def _grow(self, seen: dict[str, list[int]]) -> None:
        place = {p: k for k, p in enumerate(sorted(seen, key=lambda p: (len(p), p)))}
        self.counts: list[list[int]] = [list(seen[p]) for p in place]
        self.next: list[dict[int, int]] = [{} for _ in place]
        for p, k in place.items():
            if p:
                self.next[place[p[:-1]]][LETTERS.index(p[-1])] = k
        self.total = [sum(x) for x in self.counts]
        self._infer()
        self._complete()

    def _complete(self) -> None:
        """Where the tree ends, a symbol leads to the state to which it leads most often elsewhere."""
        usual: list[Counter] = [Counter() for _ in range(END)]
        for counts, after in zip(self.counts, self.next, strict=True):
            for k, t in after.items():
                usual[k][t] += counts[k]
        for k, seen in enumerate(usual):
            home = min(seen, key=lambda t: (-seen[t], t), default=0)
            for after in self.next:
                after.setdefault(k, home)

    def recount(self, counts: dict[tuple[int, int], int]) -> None:
        """counts: how often whole strings meet a symbol, or their end, in a state."""
        self.counts = [[counts.get((s, k), 0) for k in range(END + 1)] for s in range(len(self.next))]

    def _alike(self, a: int, b: int, depth: int = 3) -> bool:
        """Whether the symbols after both states, and after their successors, are from like distributions (Hoeffding)."""
        n, m = self.total[a], self.total[b]
        if not n or not m:
            return True
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if any(abs(x / n - y / m) > bound for x, y in zip(self.counts[a], self.counts[b], strict=True)):
            return False
        return depth == 0 or all(self._alike(t, self.next[b][k], depth - 1) for k, t in self.next[a].items() if k in self.next[b] and t != a and self.next[b][k] != b)

    def _fold(self, a: int, b: int) -> set[int]:
        """b, the root of a tree, becomes part of a. The states that change by it."""
        work, changed = [(a, b)], set()
        while work:
            a, b = work.pop()
            changed.add(a)
            self.total[a] += self.total[b]
            for k, x in enumerate(self.counts[b]):
                self.counts[a][k] += x
            for k, t in self.next[b].items():
                if k in self.next[a]:
                    work.append((self.next[a][k], t))
                else:
                    self.next[a][k] = t
        return changed

    def _infer(self) -> None:
        """Red states are final, their other successors blue; a blue state joins the first red one like it or turns red."""
        red, place, open_ = [0], {0: 0}, [0]  # open_: a heap of the places of red states that may have blue successors
        share, slack = np.zeros((16, END + 1)), np.zeros(16)  # of red states by place, for the first step of _alike

        def measure(x: int) -> tuple[np.ndarray, float]:
            n = max(self.total[x], 1)
            return np.array(self.counts[x]) / n, math.sqrt(0.5 * math.log(2 / ALPHA) / n)

        share[0], slack[0] = measure(0)
        while open_:
            r = red[open_[0]]
            found = next(((k, t) for k, t in sorted(self.next[r].items()) if t not in place), None)
            if found is None:
                heapq.heappop(open_)
                continue
            k, b = found
            own, width = measure(b)
            n = len(red)
            near = np.flatnonzero((np.abs(share[:n] - own) <= (slack[:n] + width + 1e-9)[:, None]).all(axis=1)) if self.total[b] else range(n)
            home = next((red[x] for x in near if self._alike(red[x], b)), None)
            if home is None:
                if n == len(slack):
                    share, slack = np.concatenate([share, np.zeros_like(share)]), np.concatenate([slack, np.zeros_like(slack)])
                place[b] = n
                share[n], slack[n] = own, width
                heapq.heappush(open_, n)
                red.append(b)
            else:
                self.next[r][k] = home
                for x in self._fold(home, b):
                    if x in place:
                        share[place[x]], slack[place[x]] = measure(x)
                        heapq.heappush(open_, place[x])
        self.counts = [self.counts[s] for s in red]
        self.next = [{k: place[t] for k, t in self.next[s].items()} for s in red]

    def table(self) -> list[tuple[list[float], list[int]]]:
        """By state: the log-likelihood of each symbol, with half of one more seen of each, and the state after it."""
        out = []
        for counts, after in zip(self.counts, self.next, strict=True):
            n = sum(counts) + (END + 1) * 0.5
            out.append(([math.log((c + 0.5) / n) - (SIZE_LOG[k] if k < END else 0) for k, c in enumerate(counts)], [after[k] for k in range(END)]))
        return out


def _walk_counts(strings: Iterable[tuple[str, int]], after: list[dict[int, int]]) -> Counter:
    """How often (state, symbol) and (state, END) are met by strings, each of which counts so many times."""
    out: Counter = Counter()
    for s, n in strings:
        at = 0
        for c in s:
            k = LETTERS.index(c)
            out[at, k] += n
            at = after[at][k]
        out[at, END] += n
    return out


def log_likelihood(states: list[tuple[list[float], list[int]]], s: list[int]) -> float:
    at, total = 0, 0.0
    for k in s:
        logs, after = states[at]
        total += logs[k]
        at = after[k]
    return total + states[at][0][END]


@dataclass(frozen=True)
class Formats:
    """The automata of the kinds, by name, each with the least mean likelihood of a candidate; and the background's."""

    kinds: dict[str, tuple[list, float]]
    background: list

    def kind_of(self, token: str) -> str | None:
        """The most likely format of a candidate, None if it may be ordinary."""
        s = [SYMBOL[c] for c in token]
        plain = log_likelihood(self.background, s)
        best = max(((log_likelihood(states, s), name, least) for name, (states, least) in self.kinds.items()), default=None)
        if best and best[0] - plain >= MARGIN and best[0] / len(s) >= best[2]:
            return best[1]
        return None


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, n): credentials that the patterns find, and ordinary tokens as letters (kind null), with how many."""

    def rows(found: Counter) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "value", "n"])

    held: Counter = Counter()
    for batch in batches:
        plain: Counter = Counter()
        for text in batch.column("text").to_pylist():
            if text:
                spans = base_spans(text)
                held.update((KINDS[k], c) for _, k, _, c in spans)
                if spans:
                    ahead, reach = 0, -1
                    for m in CANDIDATE.finditer(text):
                        while ahead < len(spans) and spans[ahead][0] < m.end():
                            reach, ahead = max(reach, spans[ahead][2]), ahead + 1
                        if reach <= m.start():
                            plain[m[0]] += 1
                else:
                    plain.update(CANDIDATE.findall(text))
        for token, n in plain.items():
            held[None, token.translate(SPELL)] += n
        if len(held) >= TALLY:
            yield rows(held)
            held = Counter()
    yield rows(held)


def _walked(batches: Iterator[pa.RecordBatch], after: dict[str, list[dict[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Rows (name, value, n) to (name, state, symbol, n)."""
    total: dict[str, Counter] = {name: Counter() for name in after}
    for batch in batches:
        for name, value, n in zip(*(batch.column(c).to_pylist() for c in ("name", "value", "n")), strict=True):
            total[name].update(_walk_counts([(value, n)], after[name]))
    flat = [(name, s, k, n) for name, c in total.items() for (s, k), n in c.items()]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["name", "state", "symbol", "n"])


def _means(batches: Iterator[pa.RecordBatch], states: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, values = (batch.column(c).to_pylist() for c in ("name", "value"))
        means = [log_likelihood(states[name], [LETTERS.index(c) for c in v]) / len(v) for name, v in zip(names, values, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(means, pa.float64())], names=["name", "mean"])


#: The background's name among those of the kinds.
PLAIN = "plain"


def _suspected(batches: Iterator[pa.RecordBatch], kinds: dict[str, list], plain: list) -> Iterator[pa.RecordBatch]:
    """Rows (name, value, n) with suspect: whether some kind explains the string better than the background does."""
    for batch in batches:
        spelled = [[LETTERS.index(c) for c in v] for v in batch.column("value").to_pylist()]
        suspect = [any(log_likelihood(states, s) > low for states in kinds.values()) for s in spelled for low in [log_likelihood(plain, s)]]
        yield batch.append_column("suspect", pa.array(suspect, pa.bool_()))


def _automata(strings: DataFrame) -> dict[str, Automaton]:
    """By name, the automaton of strings (name, value, n). Prefixes, symbols and ends are sums over all of them; only
    prefixes of SEEN visits and a FINE-th of the name's strings and more, and the counts of merged states, come to the
    driver: a few megabytes, whatever the corpus. Rarer strings are counted where they pass through merged states."""
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("value"), F.lit(DEPTH))))
    places = strings.select("name", "n", "value", at.alias("i")).select("name", "n", F.expr("substring(value, 1, i)").alias("prefix"), F.expr("substring(value, i + 1, 1)").alias("c"))
    sums = [F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"s{k}") for k, c in enumerate([*LETTERS, ""])]
    seen: dict[str, dict[str, list[int]]] = {}
    totals = strings.groupBy("name").agg(F.greatest(F.lit(SEEN), F.ceil(F.sum("n") / FINE)).alias("least"))
    grown = places.groupBy("name", "prefix").agg(F.sum("n").alias("n"), *sums).join(F.broadcast(totals), "name")
    for r in grown.where((F.col("n") >= F.col("least")) | (F.col("prefix") == "")).drop("least").collect():
        seen.setdefault(r["name"], {})[r["prefix"]] = list(r[3:])
    found = {name: Automaton.of_prefixes(x) for name, x in sorted(seen.items())}
    after = {name: x.next for name, x in found.items()}
    met = strings.mapInArrow(partial(_walked, after=after), "name string, state long, symbol long, n long").groupBy("name", "state", "symbol").agg(F.sum("n").alias("n")).collect()
    for name, x in found.items():
        x.recount({(r["state"], r["symbol"]): r["n"] for r in met if r["name"] == name})
    return found


def fit(strings: DataFrame) -> Formats:
    """strings: name (a kind or PLAIN), value (letters), n. Ordinary tokens hold unlabelled credentials too. So those that
    a kind explains better than the first background are left out of the second, unless they are over HIDDEN of all: so
    common a form is ordinary."""
    states = {name: x.table() for name, x in _automata(strings).items()}
    kinds = {name: x for name, x in states.items() if name != PLAIN}
    if kinds and PLAIN in states:
        tagged = strings.where(F.col("name") == PLAIN).mapInArrow(partial(_suspected, kinds=kinds, plain=states[PLAIN]), "name string, value string, n long, suspect boolean")
        tagged = staged(tagged, "secret-suspects")
        hidden, total = tagged.agg(F.sum(F.when(F.col("suspect"), F.col("n")).otherwise(0)), F.sum("n")).first()
        if 0 < hidden <= HIDDEN * total:
            states[PLAIN] = _automata(tagged.where("not suspect").drop("suspect"))[PLAIN].table()
    means: dict[str, list[float]] = {}
    for r in strings.where(F.col("name") != PLAIN).select("name", "value").mapInArrow(partial(_means, states=states), "name string, mean double").collect():
        means.setdefault(r["name"], []).append(r["mean"])
    known = {name: (states[name], sorted(x)[int(SLACK * len(x))]) for name, x in sorted(means.items())}
    return Formats(known, states.get(PLAIN) or Automaton([]).table())


def infer(docs: DataFrame, text_col: str = "text", examples: int = EXAMPLES) -> Formats:
    """The formats of the credentials in docs, against all other tokens. Examples of credentials are distinct and chosen
    by hash, at most ``examples`` of a kind, so reruns agree; a kind without examples has no automaton and adds nothing."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_examples, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = staged(found, "secret-examples")
    strings = found.where("kind is null").select(F.lit(PLAIN).alias("name"), "value", "n")
    spelled = F.translate("value", "".join(SYMBOL), "".join(LETTERS[k] for k in SYMBOL.values()))
    for kind in KINDS:
        few = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples)
        strings = strings.unionByName(few.select(F.lit(kind).alias("name"), spelled.alias("value"), F.lit(1).cast("long").alias("n")))
    return fit(staged(strings, "secret-strings"))


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


class Kinds(dict):
    def __init__(self, formats: Formats):
        self.formats = formats

    def __missing__(self, token: str) -> str | None:
        if len(self) >= MEMO:
            self.clear()
        kind = self[token] = self.formats.kind_of(token)
        return kind


def _scan(batches: Iterator[pa.RecordBatch], formats: Formats) -> Iterator[pa.RecordBatch]:
    kinds = Kinds(formats)
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            rows = [(s, k, {"kind": KINDS[k], "start": s, "end": e, "base": True}) for s, k, e, _ in spans]
            ahead, reach = 0, -1  # how far the spans reach that begin up to a candidate
            for m in CANDIDATE.finditer(text or ""):
                while ahead < len(spans) and spans[ahead][0] <= m.start():
                    reach, ahead = max(reach, spans[ahead][2]), ahead + 1
                kind = kinds[m[0]] if reach < m.end() else None
                if kind:
                    rows.append((m.start(), KINDS.index(kind), {"kind": kind, "start": m.start(), "end": m.end(), "base": False}))
            out.append([r for *_, r in sorted(rows, key=lambda x: x[:2])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, SPAN_TYPE)], names=["doc_id", "spans"])


def scan(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and its spans, by start, then kind as listed. base: found by a fixed pattern; the
    others by their format. Null and empty texts have none; other columns don't matter; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan, formats=formats), SPANS)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, infer(docs))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
