r"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score each from
its format and its context; per-kind thresholds, calibrated on held-out
examples, select. The four base kinds (email, ip, card, phone) are decided by
their format alone and always stay. The trees are trained on the driver from
generated examples of a fixed seed, so no document is needed as a label, and
scoring is one pass without a shuffle.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BASE = ("email", "ip", "card", "phone")
#: Kinds that the trees decide, listed after the base kinds.
ADDED = ("email_words", "phone_local", "ssn", "iban")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can start only where a run of digits starts: the last part takes a whole run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GENERATORS = {
    "email_words": re.compile(r"\b[a-z0-9._-]{2,64} ?[\[(]? ?at ?[\])]? ?[a-z0-9-]{2,64} ?[\[(]? ?dot ?[\])]? ?[a-z]{2,10}\b", re.IGNORECASE | re.ASCII),
    "phone_local": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
}
#: What must be in a text for a generator to find something; cheap.
_HINTS = {"email_words": re.compile(r" ?[\[(]? ?\bat\b ?[\])]? ?[a-z0-9-]{2,64} ?[\[(]? ?\bdot\b", re.IGNORECASE | re.ASCII), "iban": re.compile(r"[A-Z]{2}[0-9]{2}")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the base kinds: leftmost, non-overlapping per kind."""
    out = []
    pos, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, 0, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) <= 3 or not p[:-3].strip("0")) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) that the generators propose; they may overlap."""
    out = []
    digits = _DIGIT.search(text)
    for k, name in enumerate(ADDED, len(BASE)):
        hint = _HINTS.get(name)
        likely = "dot" in text.lower() if name == "email_words" else digits
        if likely and (hint is None or hint.search(text)):
            out += [(m.start(), k, m.end()) for m in _GENERATORS[name].finditer(text)]
    return out


#: Words near a candidate, by what they speak for.
CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address|inbox|send|message|newsletter)\b", re.IGNORECASE),
    re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|sms|whatsapp|dial|hotline|number|ring|text|landline|callback)\b", re.IGNORECASE),
    re.compile(r"\b(?:ssn|social security|taxpayer|social|tax|insurance|tin|national id)\b", re.IGNORECASE),
    re.compile(r"\b(?:iban|bank|account|swift|bic|transfer|payee|deposit|wire)\b", re.IGNORECASE),
    re.compile(r"\b(?:order|invoice|part|serial|model|version|isbn|sku|ticket|case|page|section|score|meet|lunch|noon|look|batch|lot|shipment|build|catalogue|tracking|item|ref|code|row|release)\b", re.IGNORECASE),
)
#: Endings that spelled-out addresses have.
ENDINGS = re.compile(r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$", re.IGNORECASE)
N_FEATURES = 13 + 2 * len(CONTEXT) + len(ADDED)


def features(text: str, s: int, k: int, e: int) -> list[float]:
    """Format and context of a candidate."""
    x = text[s:e]
    digits = [c for c in x if c in "0123456789"]
    before, after = text[max(0, s - 40) : s], text[e : e + 30]
    areas = re.findall("[0-9]+", x)
    first = areas[0] if areas else ""
    return [
        float(e - s), float(len(digits)), float(len(set(digits))), float(sum(c in " -.()" for c in x)),
        float("[" in x or "(" in x), float(x.islower()),
        float(iban_valid(x)) if k == KINDS.index("iban") else 0.0,
        float(first in ("000", "666") or first[:1] == "9"), float(first[:1] in ("0", "1")), float(all(a.strip("0") for a in areas)),
        float(len(areas) > 1 and areas[1][:1] in ("0", "1")), float(bool(ENDINGS.search(x))),
        float(before[-2:-1] in ("#", ":") or before[-1:] in ("#", ":")),
        *[float(bool(c.search(before))) for c in CONTEXT], *[float(bool(c.search(after))) for c in CONTEXT],
        *[float(k == len(BASE) + i) for i in range(len(ADDED))],
    ]


class Tree(NamedTuple):
    """A full tree of a fixed depth, as arrays in heap order."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        while at[0] < len(self.feature) if len(at) else False:
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.leaf[at - len(self.feature)]


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int = 3, ridge: float = 1.0) -> Tree:
    """A regression tree by second-order gain."""
    n = 2**depth - 1
    feature, cut, leaf = np.zeros(n, dtype=int), np.full(n, np.inf), np.zeros(n + 1)
    rows = {0: np.arange(len(x))}
    for node in range(n):
        r = rows.pop(node)
        best = (1e-6, 0, np.inf)
        total = g[r].sum() ** 2 / (h[r].sum() + ridge)
        for f in range(x.shape[1]):
            for c in np.unique(x[r, f])[:-1][:32]:
                low = x[r, f] <= c
                gain = g[r][low].sum() ** 2 / (h[r][low].sum() + ridge) + g[r][~low].sum() ** 2 / (h[r][~low].sum() + ridge) - total
                if gain > best[0]:
                    best = (gain, f, c)
        feature[node], cut[node] = best[1], best[2]
        low = x[r, feature[node]] <= cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = r[low], r[~low]
    for i in range(n + 1):
        r = rows[n + i]
        leaf[i] = -g[r].sum() / (h[r].sum() + ridge)
    return Tree(feature, cut, leaf)


class Model(NamedTuple):
    trees: list[Tree]
    rate: float
    thresholds: dict[int, float]

    def __call__(self, x: list[list[float]]) -> np.ndarray:
        a = np.asarray(x, dtype=float)
        return 1 / (1 + np.exp(-self.rate * sum(t(a) for t in self.trees)))


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Generated (text, start, kind, end, label): each kind in contexts for and against it."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 9)))

    def iban(valid: bool) -> str:
        body = num(rnd.choice((12, 14, 16, 18)))
        country = rnd.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        s = f"{country}{(check if valid else (check + rnd.randint(1, 90)) % 97):02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rnd.random() < 0.5 else s

    phone = lambda: (rnd.randint(201, 989), rnd.randint(200, 999), num(4))
    ssn = lambda: f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
    plain = (word, word, word, lambda: rnd.choice(("the", "is", "and", "on", "to", "at:", "")))
    any_lead = lambda *leads: rnd.choice((*leads, *plain)) if rnd.random() < 0.5 else rnd.choice(leads)
    said = lambda lead: lead() if callable(lead) else lead
    thing = lambda: rnd.choice(("order", "invoice", "part", "serial", "version", "batch", "lot", "shipment", "build", "catalogue", "ticket", "item", "ref", "code", "row", "release", "tracking"))
    makers: list[tuple[str, Callable[[], tuple[str, str]], int]] = [
        # forms that are nothing else, whatever stands before them
        ("email_words", lambda: (said(any_lead("contact", "email", "mail me:", "write to", "reach us", "send it to", "inbox")), rnd.choice((f"{word()} [at] {word()} [dot] {rnd.choice(('com', 'org', 'net'))}", f"{word()}(at){word()}(dot){rnd.choice(('com', 'org', 'info'))}", f"{word()}[at]{word()}[dot]de"))), 1),
        ("email_words", lambda: (rnd.choice(("contact", "email", "mail", "write to", "message")), f"{word()} at {word()} dot {rnd.choice(('com', 'org', 'net'))}"), 1),
        ("email_words", lambda: (rnd.choice((word(), word(), "meet", "look", "lunch", "noon")), f"{word()} at {word()} dot {word()}"[:60]), 0),
        ("phone_local", lambda: (said(any_lead("call", "phone", "tel", "mobile:", "fax", "dial", "number", "text", "ring")), "({}) {}-{}".format(*phone())), 1),
        ("phone_local", lambda: (rnd.choice(("call", "phone", "tel", "mobile:", "fax", "dial", "hotline", "number", "text", "landline")), rnd.choice(("{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(*phone())), 1),
        ("phone_local", lambda: (rnd.choice((thing(), thing(), word())), f"{num(3)}{rnd.choice('-. ')}{num(3)}{rnd.choice('-. ')}{num(4)}"), 0),
        ("ssn", lambda: (rnd.choice(("ssn", "social security", "taxpayer", "SSN:", "tax", "social", "insurance", "national id")), ssn()), 1),
        ("ssn", lambda: (rnd.choice((thing(), word(), "page", "ssn")), rnd.choice((f"9{num(2)}-{num(2)}-{num(4)}", f"000-{num(2)}-{num(4)}"))), 0),
        ("ssn", lambda: (rnd.choice((thing(), word(), "page")), f"{num(3)}{rnd.choice('- ')}{num(2)}{rnd.choice('- ')}{num(4)}"), 0),
        ("iban", lambda: (rnd.choice(("iban", "account", "bank", "transfer to", "wire", word(), word())), iban(True)), 1),
        ("iban", lambda: (rnd.choice(("iban", "serial", "model", thing(), word(), word())), iban(False)), 0),
    ]
    out = []
    while len(out) < n:
        kind, make, label = rnd.choice(makers)
        lead, body = make()
        text = f"{word()} {word()} {lead} {body} {word()} {word()}"
        k = KINDS.index(kind)
        for s, kk, e in candidates(text):
            if kk == k:
                out.append((text, s, k, e, label))
    return out[:n]


@lru_cache(1)
def train(n: int = 3000, rounds: int = 40, rate: float = 0.3, precision: float = 0.98) -> Model:
    """Trees on two thirds of the examples, thresholds on the rest: the least score
    at which a kind reaches ``precision``, 0.5 at least; over 1 if it never does."""
    rows = examples(n, 5)
    x = np.asarray([features(*r[:4]) for r in rows], dtype=float)
    y = np.asarray([r[4] for r in rows], dtype=float)
    cutoff = 2 * n // 3
    trees, f = [], np.zeros(cutoff)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        t = grow(x[:cutoff], p - y[:cutoff], p * (1 - p))
        trees.append(t)
        f += rate * t(x[:cutoff])
    p = Model(trees, rate, {})(x[cutoff:])
    thresholds = {}
    for k in range(len(BASE), len(KINDS)):
        of = np.asarray([r[2] == k for r in rows[cutoff:]])
        s, yy = p[of], y[cutoff:][of]
        good = [c for c in np.unique(s) if c >= 0.5 and yy[s >= c].mean() >= precision]
        thresholds[k] = float(min(good)) if good else 2.0
    return Model(trees, rate, thresholds)


def find_spans(text: str, model: Model) -> list[tuple[int, int, int]]:
    """Base spans and the selected candidates, as (start, kind index, end).

    A candidate that overlaps a base span gives way; of overlapping candidates
    the likelier one stays, then the longer, then the earlier.
    """
    out = base_spans(text)
    if found := candidates(text):
        p = model([features(text, *c) for c in found])
        taken = [(s, e) for s, _, e in out]
        for q, (s, k, e) in sorted(zip(p.tolist(), found, strict=True), key=lambda c: (-c[0], c[1][0] - c[1][2], c[1])):
            if q >= model.thresholds[k] and all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                out.append((s, k, e))
    return sorted(out)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, an array of (start, end, kind, base).

    Positions are code points, the end is exclusive; spans are sorted by start,
    then kind as in KINDS. Null texts count as empty and have no spans; null ids
    and repeated rows are reported each; an empty table gives an empty result;
    other columns are ignored.
    """
    trees = model or train()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"start": s, "end": e, "kind": KINDS[k], "base": k < len(BASE)} for s, k, e in find_spans(t, trees)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "found": found})

    rows = C.small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), C.whole_text(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, found array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")


def redact(text: str, model: Model | None = None) -> str:
    """The text with each span as ``[kind]``; overlapping base spans merge."""
    out, pos = [], 0
    for s, k, e in find_spans(text, model or train()):
        if s >= pos:
            out += [text[pos:s], f"[{KINDS[k]}]"]
        pos = max(pos, e)
    return "".join([*out, text[pos:]])


C.ship(__name__)
