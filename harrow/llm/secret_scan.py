"""Secret scan: base rules, and a linear-chain conditional random field that adds spans.

Base rules, leftmost non-overlapping per kind, in code points:

* assign: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``
  with ASCII letters of the names in either case; group 2 has 12 characters or more;
* access: ``AKIA[A-Z0-9]+`` of 18 characters or more;
* hex: ``[0-9a-f]+`` of 16 characters or more.

Failing matches are dropped without another try inside them.

The field tags tokens (runs of ASCII letters and digits; any other character by
itself) as secret begin, secret inside or outside.  A token can be part of a
secret only in a *run* of at least 8 characters ``[A-Za-z0-9+/_.=-]`` that holds
a digit, a change from lower to upper case, an ``=`` before something, or that
follows a quote or colon; every other token, white space included, is outside.
The tag before and after a run is therefore known, so the best path through a
whole text is the best paths through its runs, and Viterbi runs over those
alone.  Features are the token's shape (class, length, entropy, alternation,
ends), its neighbours (words and signs before and behind, in the run and around
it) and the file's (signs of code, density of runs, length).

It learns from the base spans of the texts themselves: a bounded sample of runs
(``sample`` of each side, by hash of their place), tagged by the values of the
base spans.  Runs that say nothing certain are left out: digits alone (a card
number is hex too), values after a name that are too short, spans that cut a
token.  During training, shape or neighbours of some runs are hidden, so that
each suffices alone: a value of unknown shape after a known name, or one of known
shape after an unknown name, is found.  Spans of the field that lie inside one
base span are not repeated; all others are added with kind ``crf``.

Defined results: a null text counts as empty and has no span; null and repeated
ids keep a row each; without a base span in the corpus there is nothing to learn
and nothing is added; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import id_text, rows_of, ship_code, slices, to_scratch

KINDS = ("assign", "access", "hex", "crf")
NAMES = r"(password|passwd|secret|token|api_?key)"
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = re.compile(NAMES + r"""["']?\x20*[:=]\x20*["']?(""" + VALUE + "+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")  # maximal runs of 16 or more: the same matches as HEX's, found faster
#: Every assign match holds one of these in its lower-cased text.
STEMS = ("passw", "secret", "token", "api")

RUN = re.compile(VALUE + "{8,}")
TELLING = re.compile(r"[0-9]|[a-z][A-Z]|=[^=]")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
WORD = re.compile(r"\w+|[^\w\s]")

BEGIN, INSIDE, OUT = 0, 1, 2
NEVER = -1e9
SLOTS = 1 << 14
#: Which features are hidden together while training.
SHAPE, NEIGHBOURS = slice(0, 11), slice(11, 19)
FEATURES = 23
SAMPLE, MAX_TOKENS, STEPS = 6_000, 48, 1_500


# Base rules ------------------------------------------------------------------------

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base spans, by start, then kind."""
    spans = []
    low = text.lower()
    if any(stem in low for stem in STEMS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# Runs, tokens, features ------------------------------------------------------------

@dataclass
class Run:
    start: int
    end: int
    tokens: list[tuple[int, int]]  # places in the text


def runs_of(text: str) -> list[Run]:
    """The runs in which a secret can lie."""
    found = []
    for m in RUN.finditer(text):
        s, at = m[0], m.start()
        if s.isalpha() and (s.islower() or s[1:].islower() or s.isupper()):
            if not at or (text[at - 1] not in "\"':" and text[at - 2:at] != ": "):
                continue
        elif not TELLING.search(s) and not (at and text[at - 1] in "\"':"):
            continue
        found.append(Run(at, m.end(), [(at + t.start(), at + t.end()) for t in TOKEN.finditer(s)]))
    return found


def _bucket(n: float) -> int:
    """0, 1, 2, 3, then in steps of half a power of two."""
    return int(n) if n < 4 else int(2 * math.log2(n))


def _class(s: str) -> str:
    """What a token is made of."""
    if not s.isalnum():
        return s
    if s.isdigit():
        return "9"
    letters = "a" if s.islower() else "A" if s.isupper() else "Aa" if s[1:].islower() and s.isalpha() else "aA"
    return letters + ("9" if not s.isalpha() else "") + ("x" if all(c in "0123456789abcdefABCDEF" for c in s) else "")


def _shape(s: str) -> str:
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in s[:64]]
    return "".join(k for i, k in enumerate(kinds) if i < 2 or kinds[i - 2:i] != [k, k])[:12]


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _slot(kind: int, value: object) -> int:
    return zlib.crc32(f"{kind}|{value}".encode()) % (SLOTS - 1) + 1  # slot 0 is the hidden feature


def file_features(text: str, n_runs: int) -> tuple:
    signs = sum(text.count(c) for c in "={};<>")
    size = len(text) + 1
    return _bucket(2000 * signs / size), _bucket(2000 * n_runs / size), _bucket(size / 64)


def features(text: str, run: Run, file: tuple) -> list[list[int]]:
    """FEATURES slots for each token of a run."""
    words = [t.lower() for t in WORD.findall(text[max(run.start - 48, 0):run.start])]
    before = [w for w in reversed(words) if w.isalnum()][:2] + ["", ""]
    sign = "".join(w for w in words[-3:] if not w.isalnum())
    after = (WORD.findall(text[run.end:run.end + 24]) or [""])[0].lower()
    whole = text[run.start:run.end]
    mix = _class("".join(c for c in whole if c.isalnum()) or "0"), _bucket(len(whole))
    parts = [text[a:b] for a, b in run.tokens]
    classes = [_class(p) for p in parts]
    out, name = [], before[0]
    for i, (p, c) in enumerate(zip(parts, classes, strict=True)):
        swaps = sum(x.isdigit() != y.isdigit() for x, y in zip(p, p[1:], strict=False))
        length = _bucket(len(p))
        place = "f" if not i else "l" if i == len(parts) - 1 else "m"
        values = (
            c, length, (c, length), (round(2 * _entropy(p)), length), (round(4 * swaps / len(p)), c), _shape(p), p[:4], mix,
            (_bucket(len(parts)), place), (p.isalnum(), min(swaps, 3), min(len(p) // 8, 2)), (swaps > 2, place),
            before[0], before[1], sign, after, parts[i - 1].lower() if i else "", classes[i + 1] if i + 1 < len(parts) else "",
            (name, parts[i - 1] if i else sign), name,
            *file, "")
        out.append([_slot(k, v) for k, v in enumerate(values)])
        if p.isalpha():
            name = p.lower()
    return out


def weak_tags(text: str, run: Run, spans: list[tuple[int, int, int]]) -> list[int] | None:
    """Tags of a run's tokens by the base spans; None where they say nothing certain."""
    near = max(run.start - 24, 0)
    values = []
    for m in ASSIGN.finditer(text, near, min(run.end + 1, len(text))):
        if m.end(2) > run.start and m.start(2) < run.end:
            if len(m[2]) < 12:
                return None
            values.append((m.start(2), m.start(2) + len(m[2].rstrip("."))))
    for start, kind, end in spans:
        if kind and start < run.end and end > run.start:
            if text[start:end].isdigit():
                return None
            values.append((start, end))
    tags, last = [], None
    for a, b in run.tokens:
        held = next(((x, y) for x, y in values if x <= a and b <= y), None)
        if held is None and any(x < b and a < y for x, y in values):
            return None
        tags.append(OUT if held is None else INSIDE if last is not None and a < last[1] else BEGIN)
        last = held if held is None or last is None or held[1] > last[1] else last
    return tags


# The field -------------------------------------------------------------------------

@dataclass
class Field:
    weights: np.ndarray  # (SLOTS, 3)
    moves: np.ndarray  # (3, 3), from row to column


def _clamped(moves: np.ndarray) -> np.ndarray:
    fixed = moves.copy()
    fixed[OUT, INSIDE] = NEVER
    return fixed


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, tag marginals (n, len, 3) and expected moves (3, 3) of padded runs between outside tokens."""
    n, size, _ = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = moves[OUT] + scores[:, 0]
    for t in range(1, size):
        step = _logsum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
        ahead[:, t] = np.where((t < lengths)[:, None], step, ahead[:, t - 1])
    total = _logsum(ahead[:, -1] + moves[:, OUT], 1)
    expected = np.zeros((3, 3))
    back[:, -1] = moves[:, OUT]
    for t in range(size - 2, -1, -1):
        inner = (t + 1 < lengths)
        link = moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :]
        back[:, t] = np.where(inner[:, None], _logsum(link, 2), moves[:, OUT])
        share = np.exp(ahead[:, t, :, None] + link - total[:, None, None])
        expected += share[inner].sum(axis=0)
    tags = np.exp(ahead + back - total[:, None, None]) * (np.arange(size) < lengths[:, None])[:, :, None]
    expected[OUT] += tags[:, 0].sum(axis=0)
    expected[:, OUT] += tags[np.arange(n), lengths - 1].sum(axis=0)
    return total, tags, expected


def train(runs: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, batch: int = 128, rate: float = 0.02,
          decay: float = 1e-4, hide: float = 0.4, drop: float = 0.4, seed: int = 7) -> Field:
    """Maximum likelihood by ``steps`` steps of Adam on batches of runs of like length.

    ``hide`` is the share of runs whose shapes are hidden, and of those whose
    neighbours are; ``drop`` is the share of single features hidden besides.
    """
    rng = np.random.default_rng(seed)
    runs = sorted(runs, key=lambda r: len(r[1]))
    weights, moves = np.zeros((SLOTS, 3)), np.zeros((3, 3))
    first = [np.zeros_like(weights), np.zeros_like(moves)]
    second = [np.zeros_like(weights), np.zeros_like(moves)]
    groups = [runs[i:i + batch] for i in range(0, len(runs), batch)]
    step = 0
    while step < steps:
        for g in rng.permutation(len(groups))[:steps - step]:
            group = groups[g]
            lengths = np.array([len(tags) for _, tags in group])
            n, size = len(group), int(lengths.max())
            x, y = np.zeros((n, size, FEATURES), np.int64), np.full((n, size), OUT)
            for i, (slots, tags) in enumerate(group):
                x[i, :len(tags)], y[i, :len(tags)] = slots, tags
            luck = rng.random(n)
            x[luck < hide, :, SHAPE] = 0
            x[luck > 1 - hide, :, NEIGHBOURS] = 0
            x[rng.random(x.shape) < drop] = 0
            live = np.arange(size) < lengths[:, None]
            scores = weights[x].sum(axis=2)
            _, tags, expected = marginals(scores, _clamped(moves), lengths)
            error = tags - np.eye(3)[y] * live[:, :, None]
            seen = np.zeros((3, 3))
            ends = np.concatenate([np.full((n, 1), OUT), y], axis=1)
            np.add.at(seen, (ends[:, :-1][live], ends[:, 1:][live]), 1)
            np.add.at(seen, (y[np.arange(n), lengths - 1], OUT), 1)
            flat = x.reshape(-1)
            grad = np.stack([np.bincount(flat, np.repeat(error[:, :, t].ravel(), FEATURES), SLOTS) for t in range(3)], 1)
            grad = grad / n + decay * weights
            grad[0] = 0
            step += 1
            for value, slope, m, v in zip((weights, moves), (grad, (expected - seen) / n + decay * moves),
                                          first, second, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(weights.astype(np.float32), moves)


def decode(field: Field, slots: list[list[list[int]]]) -> list[np.ndarray]:
    """Best tags of each run (Viterbi, runs of like length together)."""
    if not slots:
        return []
    lengths = np.array([len(s) for s in slots])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([np.array(s, np.int64) for s in slots])
    scores = field.weights[flat].sum(axis=1).astype(np.float64)
    moves = _clamped(field.moves)
    order = np.argsort(-lengths, kind="stable")
    best = np.full(len(slots), 0)
    came = np.zeros((len(flat), 3), np.int8)
    now = moves[OUT] + scores[starts[order]]
    for t in range(1, int(lengths[order[0]])):
        n = int(np.searchsorted(-lengths[order], -t))  # runs longer than t
        at = starts[order[:n]] + t
        ways = now[:n, :, None] + moves
        came[at] = ways.argmax(axis=1)
        now[:n] = ways.max(axis=1) + scores[at]
    best[order] = (now + moves[:, OUT]).argmax(axis=1)
    out = []
    for start, size, tag in zip(starts, lengths, best, strict=True):
        tags = np.empty(size, np.int8)
        for t in range(size - 1, -1, -1):
            tags[t] = tag
            tag = came[start + t, tag]
        out.append(tags)
    return out


def tagged_spans(text: str, run: Run, tags: np.ndarray) -> list[tuple[int, int]]:
    """Spans of begin-inside tokens, without a full stop, dash or slash at their end."""
    spans: list[list[int]] = []
    for (a, b), tag in zip(run.tokens, tags, strict=True):
        if tag == BEGIN or (tag == INSIDE and not (spans and spans[-1][1] == a)):
            spans.append([a, b])
        elif tag == INSIDE:
            spans[-1][1] = b
    cut = [(a, a + len(text[a:b].rstrip("./-"))) for a, b in spans]
    return [(a, b) for a, b in cut if a < b]


# Spark -----------------------------------------------------------------------------

TAGGED = pa.schema([("secret", pa.bool_()), ("place", pa.int64()), ("slots", pa.list_(pa.int32())), ("tags", pa.list_(pa.int8()))])


def _examples(max_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 500):
            rows = []
            for (text,) in rows_of(iter([piece]), "text"):
                runs = runs_of(text)
                if not runs:
                    continue
                spans, file = base_spans(text), file_features(text, len(runs))
                for r in runs:
                    if len(r.tokens) > max_tokens:
                        continue
                    tags = weak_tags(text, r, spans)
                    if tags is not None:
                        slots = [s for t in features(text, r, file) for s in t]
                        key = hashlib.blake2b(f"{r.start}|{text[max(r.start - 64, 0):r.end + 64]}".encode("utf-8", "replace"),
                                              digest_size=8).digest()
                        rows.append((BEGIN in tags, int.from_bytes(key, "big", signed=True), slots, tags))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(TAGGED)],
                                             schema=TAGGED)
    return run


def fit(texts: DataFrame, sample: int = SAMPLE, max_tokens: int = MAX_TOKENS) -> Field | None:
    """Train on at most ``sample`` runs with a secret and twice as many without; None if there is no secret.

    Runs of more than ``max_tokens`` tokens are not learned from (they are decoded).
    """
    runs = to_scratch(texts.select("text").mapInArrow(_examples(max_tokens), "secret boolean, place long, slots array<int>, "
                                                      "tags array<tinyint>"), "secret-runs")
    taken = []
    for secret, most in ((True, sample), (False, 2 * sample)):
        part = runs.filter(F.col("secret") == secret).orderBy("place", F.xxhash64("slots")).limit(most)
        taken += [(np.array(r["slots"]).reshape(-1, FEATURES), list(r["tags"])) for r in part.collect()]
        if not taken:
            return None
    return train(taken)


REPORT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()),
                    ("secrets", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                                    ("value", pa.string())])))])


def scan(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base, runs, owner, slots = [], [], [], []
    for i, text in enumerate(texts):
        base.append(base_spans(text))
        found = runs_of(text) if field is not None else []
        file = file_features(text, len(found))
        for r in found:
            runs.append(r)
            owner.append(i)
            slots.append(features(text, r, file))
    added: list[list] = [[] for _ in texts]
    for i, r, tags in zip(owner, runs, decode(field, slots), strict=True):
        for a, b in tagged_spans(texts[i], r, tags):
            if not any(x <= a and b <= y for x, _, y in base[i]):
                added[i].append((a, 3, b))
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


def _scanner(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 200):
            ids, texts = (list(c) for c in zip(*rows_of(iter([piece]), "doc_id", "text"), strict=True))
            rows = []
            for i, text, (base, spans) in zip(ids, texts, scan(texts, field), strict=True):
                counts = Counter(kind for _, kind, _ in base)
                secrets = [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in spans]
                rows.append((i, counts[0], counts[1], counts[2], hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(spans), len(spans) - len(base), secrets))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(REPORT)],
                                             schema=REPORT)
    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
                max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and the secrets with their values."""
    ship_code(docs.sparkSession)
    texts = id_text(docs, id_col, text_col)
    field = fit(texts, sample, max_tokens)
    return texts.mapInArrow(_scanner(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                            "spans string, n_added long, "
                            "secrets array<struct<kind:string,start:long,end:long,value:string>>")
