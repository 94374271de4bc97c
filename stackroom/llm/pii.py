"""Personal data by a skip-chain conditional random field over a document's candidate tokens.

The base patterns find emails, IP addresses, card and phone numbers; their spans are facts
and stay. Every other run of text that could be one of these (digits with separators, or a
spelled-out address) is a hidden node. Its potentials are

* unary: a log-linear score of its shape and of the words beside it;
* chain: how often kinds follow one another among a document's candidates;
* skip: agreement with the previous candidate that is the same or similar (equal digits, one
  number's digits ending in the other's, equal address whatever its spelling).

Loopy message passing spreads the facts along the skip edges, so a number or address that the
patterns know in one place is known everywhere in the document. Candidates without any skip
edge that leads to a fact keep their prior, which is "none".

Weights are learned from all candidates of a bounded sample of documents (``TRAIN_DOCS``), which
are counted where they are found; the driver gets the counts alone. Base spans give the labels, unary and skip features of the deciding signs are left out so that shape alone counts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.bpe import release_encoders, text_slices
from stackroom.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Documents that the weights are learned from, the first by a hash of their id.
TRAIN_DOCS = 2000
#: Rounds of message passing; messages have settled when none moves by TOLERANCE.
ROUNDS, TOLERANCE = 50, 1e-4
#: Shape alone never makes a span: what it says for a kind stays this far below "none".
PRIOR = 4.0
#: Nor does it say more than this against a kind: repeats lack the very sign (a plus, an at) that the
#: base pattern asks for, so learning saw such shapes as "none" alone. One fact's agreement outweighs it.
AGAINST = 6.0
#: A hidden candidate becomes a span from this marginal probability on.
ACCEPT = 0.5

# The base patterns. Possessive forms find the same matches without backtracking.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates. A number that a letter follows is none, wherever in its run one begins: that is tested
# after the match, and the lookbehinds let a run be tried once, so that every text takes linear time.
NUMBER = re.compile(r"(?<![0-9A-Za-z.])[(+]?[0-9](?:[\x20().-]{0,2}[0-9])++")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at | AT ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot | DOT |\.) ?[A-Za-z0-9-]++)+")

FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; each holds one at sign, so they are found from there."""
    end = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL_SIGNS:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            yield lo, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` sorted by kind, then start; matches that fail their test are dropped."""
    spans = [(0, lo, hi) for lo, hi in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


@dataclass
class Node:
    """A candidate: a fact when ``kind`` is known, else hidden."""

    start: int
    end: int
    kind: int | None
    key: str
    features: list[int]


def _email_key(text: str) -> str:
    t = re.sub(r"[(\[]\s*(at|dot)\s*[)\]]", r" \1 ", text.lower())
    return re.sub(r"\s+", "", re.sub(r"\s*\bdot\b\s*", ".", re.sub(r"\s+at\s+", "@", t)))


#: Unary features: digits up to 24, grouping, signs; the words beside a candidate fall in CONTEXT bins.
CONTEXT = 64
N_FEATURES = 25 + 6 + 2 * CONTEXT


def _features(text: str, lo: int, hi: int) -> list[int]:
    body = text[lo:hi]
    d = digits_of(body)
    out = [min(len(d), 24)]
    out += [25 + k for k, c in enumerate(("@", ".", "-", " ", "(", "+")) if c in body and c not in "@+"]
    before = text[max(0, lo - 40) : lo].split()[-1:]
    after = text[hi : hi + 40].split()[:1]
    for side, word in enumerate((before, after)):
        if word:
            out.append(31 + side * CONTEXT + int.from_bytes(hashlib.blake2b(word[0].lower().encode("utf-8", "surrogatepass"), digest_size=2).digest(), "little") % CONTEXT)
    return out


def _pieces(text: str, lo: int, hi: int, tails: dict[str, set[str]]) -> list[tuple[int, int]]:
    """The run ``[lo, hi)`` of digit groups, cut where groups repeat a known number or are similar to one.

    Similar numbers share their last seven digits, so a repeat ends with a group whose end has a
    tail of ``tails``. It begins where it stops to agree with the known number: at a group that
    begins there or later, if nine digits (or the whole number) remain, else at the group that
    holds the place. What is left between repeats are pieces as well. A run that is one repeat
    behind fewer than seven other digits stays whole.
    """
    groups = [(lo + g.start(), lo + g.end()) for g in re.finditer("[0-9]+", text[lo:hi])]
    digits = digits_of(text[lo:hi])
    at = [0]
    for a, b in groups:
        at.append(at[-1] + b - a)
    cuts, free_from = [], 0
    for e in range(1, len(groups) + 1):
        known = tails.get(digits[max(at[free_from], at[e] - 7) : at[e]], ())
        best = None
        for key in known:
            n = 7
            while n < len(key) and at[e] - n > at[free_from] and digits[at[e] - n - 1] == key[-n - 1]:
                n += 1
            # The first group that begins inside the digits both share.
            g = next(g for g in range(free_from, e + 1) if at[g] >= at[e] - n)
            if at[e] - at[g] < min(9, len(key)) and at[g] > at[e] - n:
                g -= 1
            found = (n, -g)
            best = found if best is None else max(best, found)
        if best:
            cuts.append((-best[1], e))
            free_from = e
    if not cuts or len(cuts) == 1 and cuts[0][1] == len(groups) and at[cuts[0][0]] < 7 and len(digits) <= 24:
        return [(lo, hi)]
    out, done = [], 0
    for a, e in [*cuts, (len(groups), len(groups))]:
        if done < a:
            out.append((lo if done == 0 else groups[done][0], groups[a - 1][1]))
        if a < e:
            start = lo if a == 0 else groups[a][0]
            # A bracket or plus sign before the first digit belongs to the number.
            out.append((start - 1 if a and text[start - 1] in "(+" else start, groups[e - 1][1]))
        done = e
    return out


def nodes_of(text: str, base: list[Span], hidden_only_if: bool = True) -> list[Node]:
    """Facts and hidden candidates in order of their place; a hidden one overlaps no fact.

    A document without facts has nothing to spread, and none is made hidden there.
    """
    if hidden_only_if and not base:
        return []
    facts = sorted((lo, hi, k) for k, lo, hi in base)
    out = [Node(lo, hi, k, text[lo:hi].lower() if k == 0 else digits_of(text[lo:hi]), _features(text, lo, hi)) for lo, hi, k in facts]
    starts = [lo for lo, _, _ in facts]
    reach = np.maximum.accumulate([hi for _, hi, _ in facts]).tolist() if facts else []

    def free(lo: int, hi: int) -> bool:
        k = bisect_right(starts, hi - 1)
        return not k or reach[k - 1] <= lo

    tails: dict[str, set[str]] = {}
    for n in out:
        if n.kind != 0 and len(n.key) >= 7:
            tails.setdefault(n.key[-7:], set()).add(n.key)
    for m in NUMBER.finditer(text):
        if text[m.end() : m.end() + 1].isascii() and text[m.end() : m.end() + 1].isalnum():
            continue
        for lo, hi in _pieces(text, *m.span(), tails):
            d = digits_of(text[lo:hi])
            if 7 <= len(d) <= 24 and free(lo, hi):
                out.append(Node(lo, hi, None, d, _features(text, lo, hi)))
    if any(k == 0 for _, _, k in facts) or not hidden_only_if:
        for m in SPELLED.finditer(text):
            if free(*m.span()):
                out.append(Node(*m.span(), None, _email_key(m[0]), _features(text, *m.span())))
    return sorted(out, key=lambda n: (n.start, n.end))


def skip_edges(nodes: list[Node]) -> list[tuple[int, int]]:
    """Each candidate with the previous one that is the same, and the previous ones that are similar.

    Numbers are similar that end in the same nine digits, or the same seven. A hidden candidate is
    also joined to the nearest fact on each side that is the same, else similar: every repeat hears
    of the fact at first hand, as a message over other repeats loses by each one's prior. Five edges
    a candidate at most, so a number repeated a thousand times makes a chain.
    """
    keys = [[n.key, *(n.key[-w:] for w in (9, 7) if n.key.isdigit() and len(n.key) >= w)] for n in nodes]
    edges, last = set(), {}
    for i, mine in enumerate(keys):
        edges.update((last[k], i) for k in mine if k in last)
        last.update(dict.fromkeys(mine, i))
    for order in (range(len(nodes)), range(len(nodes) - 1, -1, -1)):
        facts: dict[str, int] = {}
        for i in order:
            if nodes[i].kind is not None:
                facts.update(dict.fromkeys(keys[i], i))
            elif (near := next((facts[k] for k in keys[i] if k in facts), None)) is not None:
                edges.add((min(near, i), max(near, i)))
    return sorted(edges, key=lambda e: (e[1], e[0]))


@dataclass
class Weights:
    unary: np.ndarray  # N_FEATURES x (kinds + none)
    bias: np.ndarray
    chain: np.ndarray
    skip: float


def marginals(nodes: list[Node], w: Weights) -> np.ndarray:
    """Loopy sum-product over the chain and skip edges; facts are clamped."""
    n, s = len(nodes), NONE + 1
    score = np.array([w.bias + w.unary[node.features].sum(0) for node in nodes])
    for i, node in enumerate(nodes):
        if node.kind is not None:
            score[i] = -50.0
            score[i, node.kind] = 0.0
        else:
            score[i, :NONE] = np.clip(score[i, :NONE], score[i, NONE] - AGAINST, score[i, NONE] - PRIOR)
    unary = np.exp(score - score.max(1, keepdims=True))
    skip = np.where(np.eye(s, dtype=bool), np.exp(w.skip), 1.0)
    chain = np.exp(w.chain)
    # Directed edges in four blocks, each with one potential: chain and skip, there and back.
    ahead, far = np.arange(n - 1), np.array(skip_edges(nodes), int).reshape(-1, 2)
    src = np.concatenate([ahead, far[:, 0], ahead + 1, far[:, 1]])
    dst = np.concatenate([ahead + 1, far[:, 1], ahead, far[:, 0]])
    half = len(ahead) + len(far)
    blocks = [(0, chain), (len(ahead), skip), (half, chain.T), (half + len(ahead), skip.T)]
    ends = [b[0] for b in blocks[1:]] + [2 * half]
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])

    def gathered(msg: np.ndarray) -> np.ndarray:
        logs = np.log(msg)
        return np.stack([np.bincount(dst, logs[:, k], n) for k in range(s)], 1)

    msg = np.full((2 * half, s), 1 / s)
    for _ in range(ROUNDS):
        out = np.log(unary)[src] + gathered(msg)[src] - np.log(msg)[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.concatenate([out[lo:hi] @ pot for (lo, pot), hi in zip(blocks, ends)])
        new = np.maximum(new / new.sum(1, keepdims=True), 1e-30)
        moved = np.abs(new - msg).max(initial=0)
        msg = 0.5 * msg + 0.5 * new
        if moved < TOLERANCE:
            break
    out = np.log(unary) + gathered(msg)
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def find(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those that the field adds."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    if all(n.kind is not None for n in nodes):
        return base, base
    p = marginals(nodes, w)
    added = [(int(p[i, :NONE].argmax()), n.start, n.end) for i, n in enumerate(nodes) if n.kind is None and 1 - p[i, NONE] >= ACCEPT]
    return base, sorted(base + added)


def tally(nodes: list[Node]) -> Counter:
    """What learning needs of one document: ``(what, kind, other, features)`` and how often.

    Candidates by kind and features ("node"), kinds that follow one another ("chain"), and
    skip edges between facts by whether they agree ("skip").
    """
    kinds = [NONE if n.kind is None else n.kind for n in nodes]
    out = Counter(("node", k, 0, tuple(n.features)) for k, n in zip(kinds, nodes))
    out.update(("chain", a, b, ()) for a, b in zip(kinds, kinds[1:]))
    out.update(("skip", int(kinds[a] == kinds[b]), 0, ()) for a, b in skip_edges(nodes) if NONE not in (kinds[a], kinds[b]))
    return out


def train(counts: Counter, rounds: int = 200, rate: float = 0.5) -> Weights:
    """Unary weights by multinomial logistic regression, chain by counts, skip by how often similar facts agree."""
    s = NONE + 1
    unary, bias = np.zeros((N_FEATURES + 1, s)), np.zeros(s)
    chain, agree, edges, rows = np.ones((s, s)), 1.0, 2.0, []
    for (what, kind, other, features), n in sorted(counts.items()):
        if what == "node":
            rows.append((features, kind, n))
        elif what == "chain":
            chain[kind, other] += n
        else:
            edges += n
            agree += kind * n
    if rows:
        # Features of a row by number, filled up with one that weighs nothing.
        wide = max(len(f) for f, _, _ in rows)
        x = np.array([[*f, *[N_FEATURES] * (wide - len(f))] for f, _, _ in rows], np.int32)
        y = np.eye(s)[[k for _, k, _ in rows]]
        share = np.array([n for _, _, n in rows], float)[:, None]
        share /= share.sum()
        for _ in range(rounds):
            z = sum(unary[x[:, j]] for j in range(wide)) + bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - y) * share
            up = np.array([sum(np.bincount(x[:, j], g[:, k], N_FEATURES + 1) for j in range(wide)) for k in range(s)]).T
            unary -= rate * (up + 1e-3 * unary)
            unary[N_FEATURES] = 0
            bias -= rate * g.sum(0)
    unary = unary[:N_FEATURES]
    # Hidden tokens that share a fact's digits were left out of the evidence by construction:
    # the prior against a kind is bounded, so agreement with a fact can outweigh it.
    odds = np.clip(unary, -2, 2), np.clip(bias, -2, 2)
    bias = odds[1].copy()
    bias[NONE] = max(bias[NONE], 2.0)
    freq = chain / chain.sum()
    lift = np.log(freq / np.outer(freq.sum(1), freq.sum(0)))
    rate_agree = agree / edges
    return Weights(odds[0], bias, np.clip(lift, -0.5, 0.5), float(np.log(max(rate_agree, 0.5) / max(1 - rate_agree, 1e-4)) + 6))


def fit(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> Weights:
    """Learn the weights from ``n_docs`` documents of ``doc_id, text``, the first by a hash of their id."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in batches:
            counts = Counter()
            for _, texts in text_slices(b.column(0)):
                for t in texts:
                    counts.update(tally(nodes_of(t, base_spans(t), False)))
            cols = list(zip(*((*key, n) for key, n in counts.items()))) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["what", "kind", "other", "features", "n"])

    ids = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    some = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    part = some.select("text").mapInArrow(candidates, "what string, kind int, other int, features array<int>, n long")
    found = part.groupBy("what", "kind", "other", "features").agg(F.sum("n").alias("n")).collect()
    return train(Counter({(r.what, r.kind, r.other, tuple(r.features)): r.n for r in found}))


def _name(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in spans)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for every row.

    Offsets are code points, ends exclusive. Null text counts as empty and has no spans;
    repeated rows repeat; an empty table gives an empty result; other columns are not read.
    A text is read whole whatever its length, and nothing is shuffled.
    """
    docs = _prepared(docs, id_col, text_col)
    w = weights or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in batches:
            for s, texts in text_slices(b.column(1)):
                counts, digest, names = [], [], []
                for t in texts:
                    base, spans = find(t, w)
                    counts.append([sum(k == j for k, _, _ in base) for j in range(NONE)])
                    digest.append(hashlib.sha256(_name(base).encode()).hexdigest())
                    names.append(_name(spans))
                yield pa.RecordBatch.from_arrays([b.column(0)[s], *(pa.array([c[j] for c in counts], pa.int64()) for j in range(NONE)), pa.array(digest, pa.string()), pa.array(names, pa.string())], names=[f.split()[0] for f in FIELDS.split(", ")])

    return docs.mapInArrow(run, FIELDS)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans are one, of the first kind."""
    out, at = [], 0
    for lo, hi, kind in sorted((lo, -hi, k) for k, lo, hi in spans):
        hi = -hi
        if lo >= at:
            out += [text[at:lo], f"<{KINDS[kind].upper()}>"]
            at = hi
        elif hi > at:
            at = hi
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """``docs`` with its text masked and its other columns as they are; null text stays null."""
    bounded_batches(docs.sparkSession)
    w = weights or fit(_prepared(docs, id_col, text_col))
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in batches:
            for s, texts in text_slices(b.column(at)):
                columns = [c[s] for c in b.columns]
                masked = pa.array([mask(t, find(t, w)[1]) for t in texts], columns[at].type)
                columns[at] = pc.if_else(columns[at].is_valid(), masked, pa.scalar(None, masked.type))
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, schema)
