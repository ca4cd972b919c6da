"""Secret scans by a linear-chain conditional random field (operator 2).

Fixed patterns give base spans. The field tags every blank-separated word as begin, inside or outside
from its shape, its two neighbouring words and features of the file, and is decoded by Viterbi; spans it
finds are added where they reach beyond the base ones. Base spans are looked for in all documents first; then it is
trained here on windows of a bounded sample (SAMPLE, by hash, drawn from documents with and without base
spans apart): the base spans are its labels, and copies of those windows with other names, signs and
random values teach it forms that the patterns miss.

Decoding is exact and cheap: a word whose outside score leads by more than any change of its two
transitions could win back is outside on every best path, so only the short runs between such words are
searched. What a word adds to its own and its neighbours' scores is looked up per distinct word.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import keep

SAMPLE = 20_000  # documents whose windows the field is trained on
RARE = 1_000  # of these, at least so many with a base span, if there are
SIDE = 8  # words on either side of a training window's centre
ROUNDS, RATE, DECAY, SEED = 60, 0.15, 1e-3, 5
WORDS = 200_000  # distinct words a worker remembers
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and the least length of what each must hold.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Fits every text with a base span, and few others; for the JVM.
MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

_STRONG = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_WEAK = re.compile(r"(?ai:key|auth|cred|pwd|pass)")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key", "credential", "pwd")
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits)
_QUOTES = "\"'`"

OWN, NEAR, FILE = 32, 12, 8
FEATURES = OWN + 2 * NEAR + FILE


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered by start and kind; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def shape(word: str) -> tuple[list[int], list[int], int]:
    """Features of a word for itself and for its neighbours, and flags: 1 digits, 2 sign, 4 a base pattern may start here."""
    core = word.strip("\"'`.,;()[]{}<>")
    n, own = len(core), []
    own.append(next(i for i, top in enumerate((3, 7, 11, 15, 19, 23, 31, 47, 10**9)) if n <= top))  # 0-8
    digit, lower, upper = (any(t(c) for c in core) for t in (str.isdigit, str.islower, str.isupper))
    plain = core.isascii()
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in core]
    turns = sum(a != b for a, b in zip(classes, classes[1:]))
    hexes = n > 0 and plain and not core.strip("0123456789abcdefABCDEF")
    tokens = n > 0 and plain and not core.strip("+/_.=-" + string.ascii_letters + string.digits)
    random_like = tokens and n >= 16 and digit and (lower or upper) and turns >= 4
    strong, weak = bool(_STRONG.search(word)), bool(_WEAK.search(word))
    sign = word in ("=", ":", "=>", "->", ":=", "=="), word[-1:] in ("=", ":") and n > 0
    glued = re.search(r"[:=]", core[1:-1]) is not None
    facts = [digit, lower, upper, not plain, hexes and digit and not core.isdigit(), core.isdigit(), lower and upper and digit, tokens, random_like,
             turns >= 2, turns >= 6, turns >= 12, strong, weak, *sign, word[:1] in _QUOTES and n > 0, word[-1:] in _QUOTES and n > 0, word.startswith("AKIA"), "@" in core, glued, glued and strong]
    own += [9 + i for i, f in enumerate(facts) if f]
    near = [i for i, f in enumerate((strong, weak, *sign, random_like, word[:1] in _QUOTES, digit, not plain, n >= 24, glued)) if f]
    start = strong or "AKIA" in word or (len(word) >= LEAST["hex"] and _LONG_HEX.search(word) is not None)
    return own, near, digit | (sign[0] or sign[1]) << 1 | start << 2


def likeness(word: str) -> tuple | None:
    """For a common word, letters alone between signs: what its shape depends on. Words of equal likeness have equal shapes."""
    core = word.strip("\"'`.,;()[]{}<>")
    if core.isalpha() and len(core) < 24 and len(word) < 24 and (core.islower() or core.istitle()) and "KIA" not in core and not _WEAK.search(core) and not _STRONG.search(core):
        return len(core), core.islower(), core[:1].isupper(), core[1:].islower(), core.isascii(), word[:1] in _QUOTES, word[-1:] in _QUOTES
    return None


@lru_cache(100_000)
def known_shape(word: str) -> tuple[list[int], list[int], int]:
    like = likeness(word)
    return shape(word) if like is None else _shape_like(like, word)


_LIKE: dict[tuple, tuple] = {}


def _shape_like(like: tuple, word: str) -> tuple[list[int], list[int], int]:
    if like not in _LIKE:
        _LIKE[like] = shape(word)
    return _LIKE[like]


def file_features(digits: int, signs: int, words: int) -> list[int]:
    """Which of FILE features hold for a document of so many words."""
    share, size = digits / max(1, words), len(str(max(1, words)))
    return [0 if not digits else 1 if share < 0.01 else 2 if share < 0.05 else 3, 4 + (signs > 0), 6 + (size > 3)]


@dataclass
class Field:
    weights: np.ndarray  # FEATURES x 3 states: begin, inside, outside
    moves: np.ndarray  # from, to
    first: np.ndarray

    def margins(self) -> np.ndarray:
        """By how much outside must lead begin and inside to be outside on every best path."""
        before = np.maximum((self.moves - self.moves[:, 2:]).max(0), self.first - self.first[2])
        after = np.maximum((self.moves - self.moves[2:]).max(1), 0)
        return (before + after)[:2]

    def best(self, scores: np.ndarray, left: bool, right: bool) -> list[int]:
        """Viterbi over a run; ``left``/``right``: whether an outside word stands there."""
        total, back = scores[0] + (self.moves[2] if left else self.first), []
        for row in scores[1:]:
            step = total[:, None] + self.moves
            back.append(step.argmax(0))
            total = step.max(0) + row
        path = [int((total + (self.moves[:, 2] if right else 0)).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _window_features(words: list[str], marks: list[int]) -> list[list[int]]:
    shapes, out = [known_shape(w) for w in words], []
    for i, (own, _, _) in enumerate(shapes):
        before = shapes[i - 1][1] if i else []
        after = shapes[i + 1][1] if i + 1 < len(shapes) else []
        out.append(own + [OWN + f for f in before] + [OWN + NEAR + f for f in after] + [OWN + 2 * NEAR + f for f in marks])
    return out


def fit(windows: list[tuple[list[str], list[int], list[int]]]) -> Field:
    """Maximum likelihood of (words, file features, states) windows; Adam over all of them, forward-backward in one array."""
    length = max(len(w) for w, _, _ in windows)
    wide = max(len(f) for w, m, _ in windows for f in _window_features(w, m))
    index = np.full((len(windows), length, wide), FEATURES)
    gold, mask = np.full((len(windows), length), 2), np.zeros((len(windows), length), bool)
    for n, (words, marks, states) in enumerate(windows):
        for t, found in enumerate(_window_features(words, marks)):
            index[n, t, : len(found)] = found
        gold[n, : len(states)], mask[n, : len(states)] = states, True
    held = np.eye(3)[gold] * mask[..., None]
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.einsum("nti,ntj->ij", held[:, :-1] * pairs[..., None], held[:, 1:])
    cells, back = np.unique(index.reshape(-1, wide), axis=0, return_inverse=True)  # few distinct words and surroundings
    params = {"weights": np.zeros((FEATURES + 1, 3)), "moves": np.zeros((3, 3)), "first": np.zeros(3)}
    mean, square = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        score = params["weights"][cells].sum(1)[back.reshape(-1)].reshape(len(windows), length, 3)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = params["first"] + score[:, 0]
        for t in range(1, length):
            go = np.logaddexp.reduce(forward[:, t - 1, :, None] + params["moves"], axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], go, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            go = np.logaddexp.reduce(params["moves"] + (score[:, t + 1] + backward[:, t + 1])[:, None], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], go, backward[:, t + 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        miss = (np.exp(forward + backward - total) - held) * mask[..., None]
        joint = forward[:, :-1, :, None] + params["moves"] + (score + backward)[:, 1:, None, :] - total[..., None]
        cell = np.stack([np.bincount(back.reshape(-1), miss[..., s].reshape(-1), len(cells)) for s in range(3)], 1)
        grads = {
            "weights": np.stack([np.bincount(cells.reshape(-1), np.repeat(cell[:, s], wide), FEATURES + 1) for s in range(3)], 1),
            "moves": (np.exp(joint) * pairs[..., None, None]).sum((0, 1)) - seen,
            "first": miss[:, 0].sum(0),
        }
        for k, g in grads.items():
            g = g / len(windows) + DECAY * params[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            params[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        params["weights"][FEATURES] = 0
    return Field(params["weights"][:FEATURES], params["moves"], params["first"])


def label(text: str) -> tuple[list[re.Match], list[int]]:
    """Words of a text and their states by the base spans."""
    words, spans = list(re.finditer(r"\S+", text)), base_spans(text)
    states, end, at = [2] * len(words), -1, 0
    for start, _, stop in spans:
        while at < len(words) and words[at].end() <= start:
            at += 1
        i = at
        while i < len(words) and words[i].start() < stop:
            states[i] = 1 if words[i].start() < end or words[i].start() > start else 0
            i += 1
        end = max(end, stop)
    return words, states


def windows_of(text: str, draw: random.Random) -> list[tuple[list[str], list[int], list[int]]]:
    """Training windows of a text: one for each of up to four spans, one elsewhere."""
    words, states = label(text)
    if not words:
        return []
    plain = [w.group() for w in words]
    flags = [known_shape(w)[2] for w in plain]
    marks = file_features(sum(f & 1 for f in flags), sum(f >> 1 & 1 for f in flags), len(plain))
    begins = [i for i, s in enumerate(states) if s == 0]
    places = draw.sample(begins, min(4, len(begins)))
    odd = [i for i, f in enumerate(flags) if f & 1 and states[i] == 2]
    places.append(draw.choice(odd) if odd and draw.random() < 0.8 else draw.randrange(len(words)))
    return [(plain[max(0, p - SIDE) : p + SIDE + 1], marks, states[max(0, p - SIDE) : p + SIDE + 1]) for p in places]


def varied(window: tuple[list[str], list[int], list[int]], draw: random.Random) -> tuple[list[str], list[int], list[int]]:
    """A window with its secret rewritten: another name, sign and random value; without one, a lone name put in."""
    words, marks, states = window
    if 0 not in states:
        i = draw.randrange(len(words))
        return [*words[:i], draw.choice(_NAMES), *words[i + 1 :]], marks, states
    a = states.index(0)
    b = a + 1
    while b < len(states) and states[b] == 1:
        b += 1
    letters, quote, sign = draw.choice(_ALPHABETS), draw.choice(["", '"', "'"]), draw.choice("=:")
    value = "".join(draw.choice(letters) for _ in range(draw.randint(16, 48)))
    name = draw.choice(_NAMES)
    new = draw.choice([[name, sign, quote + value + quote], [name + sign, quote + value + quote], [name + sign + quote + value + quote], [value]])
    return words[:a] + new + words[b:], marks, states[:a] + [0] + [1] * (len(new) - 1) + states[b:]


def holders(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, digest, holds): which of all texts hold a base span. Python sees only texts that may."""

    def run(batches):
        for batch in batches:
            holds = [t is not None and bool(base_spans(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(holds, pa.bool_())], ["doc_id", "digest", "holds"])

    rows = docs.select(*_keys(docs), F.when(F.col("text").rlike(MAYBE), F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, holds boolean").distinct()


def _keys(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("digest")]


def sample(docs: DataFrame) -> DataFrame | None:
    """At most SAMPLE (doc_id, digest), or None where no text at all holds a base span.

    Texts with a base span get their share of the sample, and RARE places of it where their share is less.
    """
    facts = keep(holders(docs))
    counts = {r["holds"]: r["count"] for r in facts.groupBy("holds").count().collect()}  # two rows
    if not (held := counts.get(True, 0)):
        return None
    wanted = min(SAMPLE, max(min(held, RARE), SAMPLE * held // sum(counts.values())))
    order = F.xxhash64("doc_id", "digest", F.lit(SEED)), "doc_id", "digest"
    picked = [facts.where(which).orderBy(*order).limit(n) for which, n in (("holds", wanted), ("not holds", SAMPLE - wanted))]
    return picked[0].unionByName(picked[1]).drop("holds")


def train(docs: DataFrame) -> Field | None:
    """The field, or None where no text holds a secret to learn from."""
    picked = sample(docs)
    if picked is None:
        return None
    picked = F.broadcast(picked.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")))  # at most SAMPLE rows of two numbers

    def run(batches):
        for batch in batches:
            out = []
            for doc, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text"))):
                doc = digest if doc is None else doc
                for n, (words, marks, states) in enumerate(windows_of(text, random.Random(doc))):
                    if 0 in states or doc * 2654435761 % 3 == 0:
                        out.append((doc, n, words, marks, states))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "n", "words", "marks", "states"])

    rows = docs.select(*_keys(docs), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(picked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).drop("_id", "_digest")
    found = rows.mapInArrow(run, "doc_id long, n int, words array<string>, marks array<int>, states array<int>").distinct().collect()
    found.sort(key=lambda r: (r["doc_id"], r["n"], r["words"]))
    windows = [(r["words"], r["marks"], r["states"]) for r in found]
    draw = random.Random(SEED)
    more = [varied(w, draw) for w in windows for _ in range(6 if 0 in w[2] else draw.random() < 0.3)]
    return fit(windows + more)


def beyond(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """A span of the field without quotes around base spans; None where only blanks and such quotes lie outside these.

    What follows a closing quote, or precedes an opening one, without a letter or digit is such a quote too.
    """
    gaps, at = [], start
    for s, _, e in base:
        if s < end and e > start:
            if s > at:
                gaps.append((at, s))
            at = max(at, e)
    if at < end:
        gaps.append((at, end))

    def outside(a: int, b: int) -> bool:
        part = text[a:b]
        quoted = a > start and part[0] in _QUOTES or b < end and part[-1] in _QUOTES
        return not part.strip() or quoted and not any(c.isalnum() for c in part)

    told = [g for g in gaps if not outside(*g)]
    if not told:
        return None
    if gaps[0][0] == start and gaps[0] not in told:
        start = gaps[0][1]
    if gaps[-1][1] == end and gaps[-1] not in told:
        end = gaps[-1][0]
    return start, end


class Scanner:
    """All spans of texts; remembers, within a bound, what a word adds to the scores around it."""

    def __init__(self, field: Field | None):
        self.field = field or Field(np.zeros((FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
        self.limits = self.field.margins() if field else np.full(2, -np.inf)
        if field is None:
            self.field.first[2] = 1
        self.on = field is not None
        self.known: dict[str, int] = {}
        self.like: dict[tuple, int] = {}
        self.count, self.sums, self.flags = 0, np.zeros((4096, 9), np.float32), np.zeros(4096, np.int8)

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known, self.like, self.count, new = {}, {}, 0, words
        for word in new:
            like = likeness(word)
            if like is None or (i := self.like.get(like)) is None:
                i = self.add(word)
                if like is not None:
                    self.like[like] = i
            self.known[word] = i

    def add(self, word: str) -> int:
        if self.count == len(self.flags):
            self.sums, self.flags = np.vstack([self.sums, np.zeros_like(self.sums)]), np.r_[self.flags, np.zeros_like(self.flags)]
        w, (own, near, flag) = self.field.weights, shape(word)
        self.sums[self.count] = np.r_[w[own].sum(0), w[[OWN + f for f in near]].sum(0), w[[OWN + NEAR + f for f in near]].sum(0)]
        self.flags[self.count] = flag
        self.count += 1
        return self.count - 1

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of base spans and of all of the field's spans that reach beyond them; these may overlap."""
        base, found = self.parts(text)
        return sorted(base + [(r[0], 3, r[1]) for a, b in found if (r := beyond(text, a, b, base))])

    def parts(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Base spans, and (start, end) of what the field finds."""
        words = text.split()
        if not words:
            return [], []
        self.learn(set(words))
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        flags = self.flags[ids]
        base = base_spans(text) if (flags & 4).any() else []
        if not self.on:
            return base, []
        sums = self.sums[ids]
        marks = file_features(int((flags & 1).sum()), int((flags >> 1 & 1).sum()), len(words))
        scores = sums[:, :3] + self.field.weights[[OWN + 2 * NEAR + f for f in marks]].sum(0)
        scores[1:] += sums[:-1, 3:6]
        scores[:-1] += sums[1:, 6:]
        open_ = np.flatnonzero((scores[:, 2:] - scores[:, :2] <= self.limits).any(1))
        if not len(open_):
            return base, []
        found = []
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            path = self.field.best(scores[run], run[0] > 0, run[-1] < len(words) - 1)
            for i, state in zip(run.tolist(), path):
                if state == 0 or state == 1 and not (found and found[-1][1] == i):
                    found.append([i, i + 1])
                elif state == 1:
                    found[-1][1] = i + 1
        if not found:
            return base, []
        places = [m.span() for m in re.finditer(r"\S+", text)]
        return base, [(places[a][0], places[b - 1][1]) for a, b in found]


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf of every whole text.

    A null or empty text has no spans (the digest of nothing, an empty string). Repeated rows are scanned
    each; null doc_ids too. Other columns play no part.
    """

    def run(batches):
        scanner = Scanner(field)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans = scanner.spans(text)
                count = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(n for n, (_, k, _) in zip(names, spans) if k < 3)
                out.append((*count[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(names), count[3]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, field: Field | None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars`` of the new text; texts without spans stay as they were."""
    names = docs.columns

    def run(batches):
        scanner = Scanner(field)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lengths = batch.column("n_chars").to_pylist() if "n_chars" in names else [None] * len(texts)
            for i, text in enumerate(texts):
                spans = scanner.spans(text) if text else []
                if spans:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join(parts) + text[at:]
                    lengths[i] = len(texts[i])
            columns = [batch.column(c) for c in names]
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
