"""Personal data by weak supervision.

Labelers vote on candidate spans: a strict pattern, checksums and shape, gazetteers, context words before the
span, and its borders. Votes are counted by pattern in Spark; expectation-maximisation over the patterns estimates how
reliable each labeler is, and its posteriors train a logistic classifier of spans. The number of patterns is bounded
by the labelers, not by the data, so the fit takes the counts of all candidates and no sample.

Spans of the strict kinds (email, ip, card, phone) are reported always; the classifier decides on the weak kinds.

Defined results: a null text is empty and has no spans. Repeated rows each get a row. Weak candidates that overlap a
strict span or an earlier weak one are dropped, earlier kinds first. Without any candidate there is no
model and nothing is added. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelframe.session import stage

from .common import column, slices

STRICT = ("email", "ip", "card", "phone")
WEAK = ("email_text", "phone_local", "card_like", "iban", "national_id", "name")
KINDS = (*STRICT, *WEAK)

# The patterns of the strict kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An address begins at the head of its digits: a later start would only succeed where the head does, so a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Patterns of the weak kinds.
LOOSE = {
    "email_text": re.compile(r"\b[A-Za-z0-9._-]{2,40} ?[\[(]?(?:at|AT|@)[\])]? ?[A-Za-z0-9-]{2,40} ?[\[(]?(?:dot|DOT)[\])]? ?(?:com|org|net|edu|de|fr|es)\b"),
    "phone_local": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])"),
    "card_like": re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?"),
}
# Words before a span that speak for it, by kind, and against any.
CUES = {
    "email": "mail e-mail email contact write send correo courriel", "ip": "ip host server address client login gateway",
    "card": "card visa mastercard amex credit debit pay tarjeta carte karte kreditkarte", "phone": "tel phone call mobile fax whatsapp telefon telefono",
    "iban": "iban account bank konto compte cuenta", "national_id": "ssn social security tax passport insurance", "name": "patient dear sincerely contact author signed"}
CUES |= {"email_text": CUES["email"], "phone_local": CUES["phone"], "card_like": CUES["card"]}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("order invoice version isbn issn doi page pages chapter section figure table total row id no number serial".split())
DOMAIN_ENDS = frozenset("com org net edu gov io info de fr es it uk eu".split())
NAMES = frozenset("""james mary john anna maria peter paul laura david sarah thomas julia michael emma daniel sophie jose carmen pierre marie hans
karl luis ana robert linda martin claire jean antonio""".split())


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that pass the kind's test; failing ones are dropped."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split(".")))]
    for m in CARD.finditer(text):
        number = digits(m.group()) if m.end() - m.start() < 64 else ""
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def weak_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches of the loose patterns that overlap nothing found before, in order of kind."""
    held = sorted((a, b) for _, a, b in taken)
    out = []
    marks = {"email_text": "dot" in text or "DOT" in text, "name": True}
    number = DIGIT.search(text) is not None  # every other pattern needs one
    for kind, pattern in LOOSE.items():
        if not marks.get(kind, number):
            continue
        found = [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        if not found:
            continue
        starts = [a for a, _ in held]
        reach = np.maximum.accumulate([b for _, b in held]).tolist() if held else []
        for _, a, b in found:
            i = int(np.searchsorted(starts, b))  # spans that start before b
            if not i or reach[i - 1] <= a:
                out.append((kind, a, b))
        held = sorted({*held, *((a, b) for k, a, b in out if k == kind)})
    return out


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 no opinion."""
    span, number = text[a:b], digits(text[a:b])
    if kind in ("card", "card_like"):
        check = 1 if luhn(number) else -1
    elif kind == "iban":
        check = 1 if mod97(span) else -1
    elif kind in ("phone", "phone_local"):
        check = 1 if len(set(number)) > 2 else -1
    elif kind == "ip":
        check = -1 if span.startswith(("0.", "127.", "255.")) else 1
    else:
        check = 0
    if kind in ("email", "email_text"):
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in DOMAIN_ENDS else -1
    elif kind == "name":
        gazetteer = 1 if any(w.lower() in NAMES for w in span.split()) else 0
    elif kind in ("card", "card_like"):
        gazetteer = 1 if number[0] in "3456" else -1
    else:
        gazetteer = 0
    before = re.findall(r"[^\W\d_]+", text[max(0, a - 40):a].lower())[-4:]
    context = 1 if CUES[kind] & set(before) else -1 if AGAINST & set(before[-2:]) else 0
    left, right = text[a - 1:a], text[b:b + 1]
    border = -1 if (left.isalnum() or right.isalnum()) else 1 if (not left or left.isspace()) else 0
    return (1 if kind in STRICT else 0, check, gazetteer, context, border)


LABELERS = ("strict", "check", "gazetteer", "context", "border")


def shape(text: str, a: int, b: int) -> int:
    """A coarse size of the span, the classifier's own feature beside the votes."""
    return min(3, (b - a) // 8)


def _candidates(carry: list[str]):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())])

    def run(batches):
        for batch in slices(batches, "text"):
            found = []
            for text in column(batch, "text").to_pylist():
                text = text or ""
                strict = strict_spans(text)
                spans = strict + weak_spans(text, strict)
                found.append([{"kind": k, "start": a, "end": b, "pattern": " ".join(map(str, (k, *votes(text, k, a, b), shape(text, a, b))))}
                              for k, a, b in spans])
            yield pa.record_batch([*[column(batch, c) for c in carry], pa.array(found, pa.list_(span))], names=[*carry, "found"])
    return run


@dataclass
class SpanModel:
    """What expectation-maximisation and the classifier learned; ``accept`` maps patterns to probabilities."""

    reliability: dict[str, tuple[float, float]]
    accept: dict[str, float]


def learn(patterns: dict[str, int], rounds: int = 50) -> SpanModel:
    """Fit to counts of patterns (kind, a vote per labeler, shape)."""
    if not patterns:
        return SpanModel({}, {})
    keys = sorted(patterns)
    kind = np.array([KINDS.index(k.split()[0]) for k in keys])
    vote = np.array([[int(v) for v in k.split()[1:-1]] for k in keys])
    size = np.array([int(k.split()[-1]) for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    post = 1 / (1 + np.exp(-vote.sum(1)))  # the labelers' majority to begin with
    for _ in range(rounds):
        prior = np.array([(1 + (n * post)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        logit = np.log(prior / (1 - prior))[kind]
        for j in range(vote.shape[1]):
            for v in (-1, 0, 1):
                here = vote[:, j] == v
                if v and here.any():  # silence tells nothing
                    spoke = vote[:, j] != 0
                    yes = (1 + (n * post)[here].sum()) / (2 + (n * post)[spoke].sum())
                    no = (1 + (n * (1 - post))[here].sum()) / (2 + (n * (1 - post))[spoke].sum())
                    logit[here] += np.log(yes / no)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    reliability = {}
    for j, name in enumerate(LABELERS):
        yes, no = n * post, n * (1 - post)
        spoke = vote[:, j] != 0
        reliability[name] = (float(yes[vote[:, j] == 1].sum() / max(1e-9, yes[spoke].sum())), float(no[vote[:, j] == -1].sum() / max(1e-9, no[spoke].sum())))
    x = np.column_stack([np.eye(len(KINDS))[kind], *(vote == v for v in (-1, 1)), np.eye(4)[size], np.ones(len(keys))]).astype(float)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(25):  # Newton steps of a ridge logistic fit to the posteriors
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - post)) + 1e-4 * w)
    return SpanModel(reliability, dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist())))


def _judge(accept, threshold: float, carry: list[str]):
    """Strict spans, and weak ones whose pattern the classifier accepts."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches):
        for batch in batches:
            out = [[{"kind": s["kind"], "start": s["start"], "end": s["end"], "p": p} for s in spans
                    for p in (1.0 if s["kind"] in STRICT else accept.value.get(s["pattern"], 0.0),) if p >= threshold]
                   for spans in column(batch, "found").to_pylist()]
            yield pa.record_batch([*[column(batch, c) for c in carry], pa.array(out, pa.list_(span))], names=[*carry, "spans"])
    return run


def find_personal_data(docs: DataFrame, carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``carry`` (doc_id) and ``spans``, an array of (kind, start, end, probability), strict ones with 1, ordered by kind and start."""
    carry = carry or ["doc_id"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"{kinds}, found array<struct<kind:string,start:int,end:int,pattern:string>>"
    found = stage(docs.select(*carry, "text").mapInArrow(_candidates(carry), schema), "pii")
    counted = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count()
    model = learn({r.pattern: r["count"] for r in counted.collect()})  # at most kinds * 3 ** labelers * 4 rows
    accept = docs.sparkSession.sparkContext.broadcast(model.accept)
    return found.mapInArrow(_judge(accept, threshold, carry), f"{kinds}, spans array<struct<kind:string,start:int,end:int,p:double>>")
