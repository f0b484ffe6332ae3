"""Personal data: base patterns, further candidate spans, boosted trees that decide about them.

Base spans (email, ip, card, phone) follow four fixed patterns with checks and always stay. On top,
generators of high recall propose spans the patterns miss: spelled-out mail addresses, phone numbers
without a leading plus, numbers shaped like cards, eight-part addresses. Proposals may overlap. A
boosted ensemble scores each from its format and its context; the score is calibrated on held-out
rows, and each kind has its own threshold, the least that keeps the wanted precision there. What
passes is taken by score, best first, where it overlaps no base span and nothing taken before.

There are no labelled spans to learn from, so the trees learn from a fixed, seeded set of
`EXAMPLES` printed examples of both classes; the fit takes a second on the driver and only the trees
travel to the executors. Finding is one narrow pass over whole texts: no shuffle, no cross-row state.
All scans are linear in a text's length: patterns that could rescan a long run of letters or digits
are anchored at its start.

Defined edge cases: null and empty texts have no spans; equal texts have equal spans; offsets count
code points, ends are exclusive; further columns are ignored or, in `redact`, kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .boosting import Trees
from .common import ready, table

KINDS = ("email", "ip", "card", "phone")
#: Training examples, and the precision each kind's threshold must keep on held-out ones.
EXAMPLES, PRECISION = 3000, 0.99

LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
#: Base patterns; a digit run is entered at its start only, which finds the same matches.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the mail pattern, found from each @ outwards."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans in order of kind and start; card-like runs that failed the checksum."""
    out: list[Span] = []
    doubtful: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() <= 40 else ""
            if 13 <= len(digits) <= 19:
                (out if luhn(digits) else doubtful).append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out, doubtful


# --- further candidates ---------------------------------------------------------------------

SPELLED = re.compile(
    r"(?<![\w.+-])[\w.+-]{1,64}\s{0,2}[\[({]\s?at\s?[\])}]\s{0,2}[\w-]{1,63}"
    r"(?:\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}])\s{0,2}[\w-]{1,63}){1,5}",
    re.IGNORECASE,
)
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:00[ -]?\d{1,3}[ -]?)?(?:\(\d{2,4}\)|\d{2,4})[ ./-]\d{3,4}[ .-]\d{3,4}(?![\w-])")
EIGHT = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")


def candidates(text: str, doubtful: list[Span]) -> list[Span]:
    """Spans the base patterns miss; they may overlap each other and base spans."""
    out = list(doubtful)
    if re.search(r"[\[({]\s?at\s?[\])}]", text, re.IGNORECASE):
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        if ":" in text:
            out += [("ip", *m.span()) for m in EIGHT.finditer(text)]
    return out


CONTEXT = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        r"\b(?:call|phone|tel|fax|mobile|cell|dial|sms)",
        r"\b(?:card|visa|credit|debit|payment|account|iban)",
        r"\b(?:mail|contact|write|reach|from)",
        r"\b(?:ip|host|server|addr|client|node)",
        r"\b(?:version|release|isbn|order|ref|invoice|serial|hash|token|key|sha|commit|id)\b",
    )
)


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, s, e = span
    body, left, right = text[s:e], text[max(0, s - 28) : s], text[e : e + 2]
    digits = _digits(body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(body)),
        float(len(digits)),
        float(sum(c.isalpha() for c in body)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(len(set(digits))),
        float(bool(digits) and digits[0] in "3456"),
        float(len(groups) > 1 and len(set(groups)) == 1),
        float("(" in body),
        float(left[-1:].isalnum()),
        float(left[-1:] in ('"', "'", "=", "/", "#", "-", ".", "_")),
        float(right[:1].isalnum()),
        float(right[:1] in ('"', "'", "/", "-", "_")),
        *(float(bool(p.search(left))) for p in CONTEXT),
    ]


# --- training examples ----------------------------------------------------------------------


def _examples(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of the candidates in `n` printed example lines."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("aeioulnrstdm"), rng.integers(3, 9)))
    x, y, kinds = [], [], []
    for _ in range(n):
        good = bool(rng.random() < 0.5)
        kind = pick("email", "card", "phone", "ip")
        noise = " ".join(word() for _ in range(rng.integers(1, 4)))
        if kind == "email":
            at, dot = pick(("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", " [dot] "), ("{at}", "{dot}"))
            body = f"{word()}{at}{word()}{dot}{pick('com', 'org', 'net', 'de')}"
            if not good:
                body = f"{num(2)}{pick('(at)', '[at]')}{num(3)}.{num(3)}"
            lead = pick("mail me ", "contact ", noise + " ", "")
        elif kind == "card":
            body = pick(num(16), f"{pick(*'3456')}{num(15)}", " ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4)))
            lead = pick("card ", "visa ", noise + " ", noise + ". ", "payment with ")
            if not good:
                body = pick(num(13), num(14), num(18), num(19), num(17), num(16))
                lead = pick("order id ", "isbn ", "hash ", "serial-", 'token = "', noise + " ref/", "sha ") if len(body) == 16 else pick("order ", "isbn ", noise + " ", 'key "')
        elif kind == "phone":
            body = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"00{num(2)} {num(3)} {num(4)}-{num(4)}")
            lead = pick("call ", "tel. ", noise + " ", "fax: ", "phone ")
            if not good:
                body = pick(f"{num(2)}/{num(4)}-{num(4)}", f"{num(4)}-{num(4)}-{num(4)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(4)} {num(3)} {num(3)}")
                lead = pick("version ", "ref ", "isbn ", "invoice ", noise + " id ", noise + " ")
        else:
            body = ":".join("".join(rng.choice(list("0123456789abcdef"), 4)) for _ in range(8))
            lead = pick("host ", "ip ", noise + " ", "from ")
            if not good:
                body, lead = ":".join(num(2) for _ in range(8)), pick("hash ", "serial ", "key ", noise + " ")
        text = f"{noise} {lead}{body}{pick('', '.', ' ' + word(), ',')}" if good else f"{noise} {lead}{body}{pick('', '.', word(), '-' + num(3), ' ' + word())}"
        _, doubtful = base_spans(text)
        for c in candidates(text, doubtful):
            x.append(features(text, c))
            y.append(float(good and c[0] == kind))
            kinds.append(c[0])
    return np.array(x), np.array(y), kinds


class Model:
    """Calibrated trees and a threshold for each kind."""

    def __init__(self, trees: Trees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fit(cls, examples: int = EXAMPLES, precision: float = PRECISION) -> Model:
        x, y, kinds = _examples(examples)
        held = np.arange(len(y)) % 2 == 1
        trees = Trees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        chance, kind = trees.chance(x[held]), np.array(kinds)[held]
        thresholds = {}
        for k in KINDS:
            p, t = chance[kind == k], y[held][kind == k]
            order = np.argsort(-p)
            kept = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            fine = np.flatnonzero(kept >= precision)
            thresholds[k] = max(0.5, float(p[order][fine[-1]])) if len(fine) else 1.1
        return cls(trees, thresholds)

    def select(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        found, rows, owner = [], [], []
        for i, text in enumerate(texts):
            base, doubtful = base_spans(text)
            more = candidates(text, doubtful)
            found.append((base, more))
            rows += [features(text, c) for c in more]
            owner += [i] * len(more)
        chance = iter(self.trees.chance(np.array(rows)).tolist() if rows else [])
        out = []
        for base, more in found:
            scored = [(p, c) for c in more if (p := next(chance)) >= self.thresholds[c[0]]]
            taken = list(base)
            for _, c in sorted(scored, key=lambda x: (-x[0], x[1])):
                if all(c[2] <= s or e <= c[1] for _, s, e in taken):
                    taken.append(c)
            out.append((base, sorted(taken, key=lambda t: (KINDS.index(t[0]), t[1], t[2]))))
        return out


def show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Key, the number of base spans of each kind, base_sha256 and all spans of every text."""
    ready(docs.sparkSession)
    model = model or Model.fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.select([t.as_py() or "" for t in batch.column(1)])
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(show(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([show(s) for _, s in found], pa.string())],
                names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    )


def cover(text: str, spans: list[Span]) -> str:
    """`text` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """`docs` with the spans in its text covered; null texts stay null, all columns are kept."""
    ready(docs.sparkSession)
    model = model or Model.fit()
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = model.select([t or "" for t in texts])
            new = [t if t is None or not spans else cover(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(table(ready(spark), sf_dir, "documents"))
