"""Personal data: rule spans, plus candidate spans that boosted trees accept.

Generators with high recall propose overlapping spans (e-mail like words, written-out addresses, runs of digit
groups).  Gradient-boosted regression trees score each candidate from its format and its context; a threshold
per kind, calibrated for precision on candidates kept out of the fit, selects what is added to the rule spans.
The trees learn formats that the rules do not know: rule hits and the entries of a small documented table are
rewritten (``written``) in their own contexts, as numbers without "+", addresses with (at)/[dot], cards with other
separators, four octets with bracketed or written dots, next to look-alikes (``LOOK_ALIKES``).  Positive is the
rewritten span as a whole, negative every other candidate there.  What only the rules' formats have ("+") is masked.

Documents are independent: one pass over all texts gathers the rule hits, one finds the spans.  The trees are
fitted on at most ``sample_hits`` different hits per kind, picked by hash from those of all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import map_rows, stored

KINDS = ("email", "ip", "card", "phone")

# The rule patterns of the contract.  The e-mail rule is matched from its "@" outwards and the ip
# rule from the start of a digit run with possessive repeats: the same matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,3}[0-9])+")
_ATS = ("(at)", "[at]", " at ")
_HOST = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,}+)++")
_DOT = re.compile(r" ?(?:\.|\(dot\)|\[dot\]| dot )")
_OCTETS = re.compile(r"(?<![0-9])[0-9]++(?: ?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\]| dot ) ?[0-9]++){3,}+")
_GROUP = re.compile(r"[0-9]+")
_NO_LETTERS = str.maketrans("", "", ascii_letters)         # candidates hold ASCII characters only

SPANS = "array<struct<kind:string,start:long,end:long,origin:string,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) < 3 or (len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255") for p in s.split("."))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rules, in the order of the kinds, then by start."""
    found: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if _octets(m[0]):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping (kind number, start, end) proposals: a few per ``@``, written at or dot, and per digit group."""
    out = set()
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        while end < len(text) and (text[end] in _LOCAL):
            end += 1
        if start < at < end - 1:
            out.add((0, start, end))
            out.add((0, start, at + 1 + len(text[at + 1:end].rstrip("._%+-"))))
        at = text.find("@", at + 1)
    for word in _ATS:
        at = text.find(word)
        while at >= 0:
            host = _HOST.match(text, at + 4)
            if host:
                start = end = at - (text[at - 1:at] == " ")
                while start > 0 and text[start - 1] in _LOCAL:
                    start -= 1
                if start < end:
                    out.update((0, start, p.start()) for p in [*_DOT.finditer(text, host.start(), host.end())][1:])
                    out.add((0, start, host.end()))
            at = text.find(word, at + 3)
    for run in _OCTETS.finditer(text):
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, run.start(), run.end())]
        out.update((1, a, b) for (a, _), (_, b) in zip(groups, groups[3:], strict=False))
    for run in _NUMBERS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, run.start(), run.end())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                start, end = groups[i][0], groups[j][1]
                if digits >= 13:
                    out.add((2, start, end))
                if 9 <= digits <= 15:
                    before = text[start - 2:start] if start > 1 else text[:start]
                    lead = 2 if before == "+(" else 1 if before[-1:] in ("+", "(") and before else 0
                    out.add((3, start - lead, end))
    return sorted(out)


FEATURES = ("length", "digits", "groups", "first_group", "last_group", "widest_less_narrowest", "spaces", "dashes",
            "dots", "parentheses", "plus", "luhn", "octets", "letters", "ats", "before", "after", "before_digit_gap",
            "after_digit_gap", "context_letters", "context_digits", "line_digits", "brackets", "written_dots", "top_level", "sentence_ends")

#: Top-level names that written-out addresses end in.
_TOP = frozenset("com org net edu gov info io eu de fr es uk us ch at it nl".split())

#: Fixed values and contexts for kinds that a sample has no or few rule hits of.
TABLE = ((0, ("jane.roe@mail.example.com", "info@example.org", "k_lee7@uni-x.example.edu", "max@firma.example.de")),
         (1, ("192.0.2.17", "10.20.30.40", "203.0.113.255", "172.16.254.1")),
         (2, ("4111111111111111", "5500005555555559", "340000000000009", "6011000000000004")),
         (3, ("+1 (394) 555-4006", "+1 (212) 555-0187", "+1 (808) 555-2368", "+1 (615) 555-7741")))
CONTEXTS = (("please write to ", " for details"), ("", ""), ("(", ")"), ("Contact: ", ".\nThank you"), ("the ", ", or later"),
            ("und dann ", " oder so"), ("de la ", " en el"), ("ref ", "; see below"))

#: Texts with candidates that are none of the kinds: dates, series, decimals, identifiers, wrong check digits, prose.
LOOK_ALIKES = {
    0: ("we met at noon. Then home", "look at this dot on the map", "a point at one dot of it", "stay at home. Now rest",
        "(at) all. And so on", "arrive at ten dot then wait", "sold at cost. In all", "be at rest. It ends",
        "look at that. It is", "sat at noon. At one", "waited at home. Us too", "all at once. De la"),
    1: ("300[.]1[.]2[.]3", "2001 dot 2002 dot 2003 dot 2004", "256 . 100 . 3 . 2", "1.2.3.4.5.6.7", "2024.01.15.2024.01.16",
        "1. 2. 3. 4. 5", "12 . 999 . 7 . 1", "10(.)20(.)30(.)444", "7. 15. 2003. 9", "3.14.15.92.65"),
    2: ("4111.1111.1111.1112", "1234.5678.9012.3456", "5500/0055/5555/5550", "4111  1111  1111  1113", "3400.0000.0000.008",
        "6011/0000/0000/0005", "2024.01.15.2024.01.16", "1000 2000 3000 4000 5",
        "10.20.30.40.50.60.70.88", "1.2.3.4.5.6.7.8.9.0.1.2.8", "21/34/15/26/17/38/49/51"),
    3: ("2024-03-15 10", "1999-12-31 23", "10 20 30 40 50 60", "3.14159265358", "0.0012345678", "812088970", "7435553824",
        "12-3456-78901", "100 200 300 400", "1000 2000 3000", "5731080387325255", "2024/01/15 2024", "123456-7890",
        "1.2.3.4.5.6.7.8.9", "12345 67890 12", "2001 2002 2003",
        "10 20 30 40 50 60 70 80", "1 2 3 4 5 6 7 8 9 10"),
}


def written(kind: int, value: str) -> list[str]:
    """Forms of an e-mail, address, card or phone value that the rules do not match."""
    d = _digits(value)
    if kind == 0:
        name, host = value.split("@", 1)
        return [name + a + host.replace(".", b) for a, b in (
            (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " dot "), (" at ", "."))]
    if kind == 1:
        return [s.join(value.split(".")) for s in ("[.]", "(.)", " dot ", "(dot)", "[dot]", " . ")] + ["[.]".join(value.rsplit(".", 1))]
    if kind == 2:
        parts = [d[i:i + 4] for i in range(0, len(d), 4)]
        return [s.join(parts) for s in (".", "/", "  ", " - ")]
    local = d[-10:]
    a, b, c = local[:3], local[3:6], local[6:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"001 {a} {b} {c}"]


def _class_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context features of a span; the context is 24 characters on either side."""
    s = text[start:end]
    groups = _GROUP.findall(s)
    sizes = [len(g) for g in groups] or [0]
    left, right = text[max(0, start - 24):start], text[end:end + 24]
    around = left + right
    gap = lambda part: next((i for i, c in enumerate(part) if "0" <= c <= "9"), 25)
    d = "".join(groups)
    near = max(1, len(around))
    stem = s.rstrip(ascii_letters)
    digits_near = sum("0" <= c <= "9" for c in around)
    return [len(s), len(d), len(sizes), sizes[0], sizes[-1], max(sizes) - min(sizes), s.count(" "), s.count("-"),
            s.count("."), s.count("(") + s.count(")"), 0.0, float(len(d) < 20 and luhn(d)),
            float(kind == 1 and _octets(".".join(groups))), len(s) - len(s.translate(_NO_LETTERS)), s.count("@"), _class_of(left[-1:]),
            _class_of(right[:1]), gap(left[::-1]), gap(right), sum(c.isalpha() for c in around) / near,
            digits_near / near, digits_near, s.count("["), s.count("dot"),
            float((not stem.endswith(". ") and s[len(stem):].lower() in _TOP) or s.endswith(("dot)", "dot]"))), s.count(". ")]


class Boosted:
    """Gradient-boosted regression trees for a yes/no target: logistic loss, binned features, depth-wise growth."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.forest, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            tree = {}
            at = np.zeros(len(y), np.int64)
            for _ in range(self.depth):
                for node in np.unique(at).tolist():
                    rows = np.flatnonzero(at == node)
                    split = self._split(binned[rows], g[rows], h[rows])
                    if split:
                        f, b = split
                        tree[node] = (f, float(self.edges[f][b]))
                        at[rows] = 2 * node + 1 + (binned[rows, f] > b)
            leaves = {n: float(self.rate * g[at == n].sum() / (h[at == n].sum() + 1.0)) for n in np.unique(at).tolist()}
            raw += np.array([leaves[n] for n in at.tolist()])
            self.forest.append((tree, leaves))
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        best, where = 1e-6, None
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f, e in enumerate(self.edges):
            if not len(e):
                continue
            n = len(e) + 1
            gs = np.cumsum(np.bincount(binned[:, f], g, n))[:-1]
            hs = np.cumsum(np.bincount(binned[:, f], h, n))[:-1]
            ns = np.cumsum(np.bincount(binned[:, f], minlength=n))[:-1]
            gain = gs ** 2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < self.least) | (len(g) - ns < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (f, k)
        return where

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if not self.forest:
            return 1 / (1 + np.exp(-raw))
        nodes = 2 ** (self.depth + 1) - 1
        column, edge, value = (np.full((len(self.forest), nodes), v) for v in (-1, np.inf, 0.0))
        for i, (tree, leaves) in enumerate(self.forest):
            for node, split in tree.items():
                column[i, node], edge[i, node] = split
            value[i, list(leaves)] = list(leaves.values())
        trees, rows = np.arange(len(self.forest))[:, None], np.arange(len(x))
        at = np.zeros((len(self.forest), len(x)), np.int64)
        for _ in range(self.depth):                  # all trees at once
            f = column[trees, at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, f] > edge[trees, at]))
        for leaf in value[trees, at]:
            raw += leaf
        return 1 / (1 + np.exp(-raw))


def _examples(kind: int, hits: list[tuple[str, str, str]]) -> list[list[tuple[float, list[float]]]]:
    """Per text the label and description of each candidate of the kind: rewritten hits and look-alikes."""
    fixed = [(left, v, right) for k, values in TABLE if k == kind for v in values for left, right in CONTEXTS]
    out = []
    for i, (left, value, right) in enumerate(hits + fixed):
        forms = written(kind, value)
        for form, label in [(f, 1.0) for f in (forms if i >= len(hits) else [forms[i % len(forms)]])] \
                + [(LOOK_ALIKES[kind][(i + j) % len(LOOK_ALIKES[kind])], 0.0) for j in range(2 if i < len(hits) else 4)]:
            text, whole = left + form + right, (kind, len(left), len(left) + len(form))
            rows = [(float(label and c == whole), describe(text, *c)) for c in candidates(text)
                    if c[0] == kind and c[1] < whole[2] and whole[1] < c[2]]
            if rows:
                out.append(rows)
    return out


def fit(docs: DataFrame, sample_hits: int = 600, precision: float = 0.99) -> dict[int, tuple[Boosted, float]]:
    """Model and threshold per kind, from rewritten rule hits of all documents and the table.

    At most ``sample_hits`` different hits per kind are rewritten.  A third of the texts is kept out of the fit for
    the threshold.  ``docs`` has doc_id, text.
    """
    if docs.isEmpty():
        return {}

    def rows(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"kind": [], "left": [], "value": [], "right": []}
        for t in texts.to_pylist():
            for k, a, b in rule_spans(t or ""):
                for name, x in zip(out, (k, t[max(0, a - 30):a], t[a:b], t[b:b + 30]), strict=True):
                    out[name].append(x)
        yield out

    found = stored(map_rows(docs, rows, "kind int, left string, value string, right string").distinct()
                   .withColumn("h", F.xxhash64("left", "value", "right")), "rule-hits")
    total = dict(found.groupBy("kind").count().collect())
    models = {}
    for kind in LOOK_ALIKES:
        # hashes are even: twice the wanted share of them holds enough, and few rows at any size
        most = min(2 ** 63 - 1, -2 ** 63 + 2 ** 65 * sample_hits // max(total.get(kind, 0), 1))
        got = found.where((F.col("kind") == kind) & (F.col("h") <= most)).orderBy("h", "left", "value", "right").limit(sample_hits).collect()
        texts = _examples(kind, [(r["left"], r["value"], r["right"]) for r in got])
        label = [np.array([y for y, _ in rows]) for rows in texts]
        x = [np.array([v for _, v in rows], float) for rows in texts]
        inside = [i for i in range(len(texts)) if i % 3]
        aside = range(0, len(texts), 3)
        model = Boosted().fit(np.concatenate([x[i] for i in inside]), np.concatenate([label[i] for i in inside]))
        score = model.predict(np.concatenate([x[i] for i in aside]))
        least = calibrate(score, np.concatenate([label[i] for i in aside]), precision)
        below = score[score < least].max(initial=0.0)
        if least <= 1:                               # as precise on what is kept out, with room for scores not seen there
            least = min(least, max(0.75, (least + float(below)) / 2))
        models[kind] = (model, least)
    return models


def calibrate(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest score from which on the (add-one) precision holds; over 1 when it never does."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    ok = (hits + 1) / (np.arange(1, len(s) + 1) + 1) >= precision
    ok &= np.append(s[1:] < s[:-1], True)          # never between equal scores
    return float(s[np.flatnonzero(ok)[-1]]) if ok.any() else 1.01


def all_spans(text: str, models: dict[int, tuple[Boosted, float]]) -> list[tuple[int, int, int, str, float]]:
    """Rule spans, and the accepted candidates that overlap neither them nor a better candidate."""
    rules = rule_spans(text)
    out = [(*s, "rule", 1.0) for s in rules]
    proposed = [c for c in candidates(text) if c[0] in models]
    if proposed:
        taken = [(a, b) for _, a, b in rules]
        free = [c for c in proposed if not any(c[1] < b and a < c[2] for a, b in taken)] if len(taken) < 50 else \
            _clear_of(proposed, taken)
        scored = []
        for kind in sorted({c[0] for c in free}):
            own = [c for c in free if c[0] == kind]
            model, least = models[kind]
            p = model.predict(np.array([describe(text, *c) for c in own], float))
            scored += [(q, c) for q, c in zip(p.tolist(), own, strict=True) if q >= least]
        kept: list[tuple[int, int]] = []             # disjoint, in order
        for q, c in sorted(scored, key=lambda r: (-r[0], r[1])):
            k = bisect_left(kept, c[1:])
            if (k == 0 or kept[k - 1][1] <= c[1]) and (k == len(kept) or c[2] <= kept[k][0]):
                kept.insert(k, c[1:])
                out.append((*c, "model", q))
    return sorted(out)


def _clear_of(spans, taken):
    """Spans that overlap none of ``taken`` (many of each: by bisection on merged intervals)."""
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts, ends = np.array([m[0] for m in merged]), np.array([m[1] for m in merged])
    s = np.array([c[1] for c in spans])
    e = np.array([c[2] for c in spans])
    k = np.searchsorted(ends, s, side="right")
    clear = (k == len(starts)) | (starts[np.minimum(k, len(starts) - 1)] >= e)
    return [c for c, ok in zip(spans, clear.tolist(), strict=True) if ok]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, origin rule or model, score): one row per input row.

    A null text counts as empty and has no spans; repeated rows are searched one by one; an empty table gives
    an empty result (and no model); other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    models = fit(rows, **fit_options)

    def spans(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        found = [[{"kind": KINDS[k], "start": a, "end": b, "origin": o, "score": q}
                  for k, a, b, o, q in all_spans(t or "", models)] for t in texts.to_pylist()]
        yield {"doc_id": ids, "spans": found}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, spans, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets (overlapping spans become one)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    models = fit(rows, **fit_options)

    def clean(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        out = []
        for t in texts.to_pylist():
            parts, last = [], 0
            for a, b, k in sorted((a, b, k) for k, a, b, _, _ in all_spans(t or "", models)):
                if a >= last:
                    parts += [t[last:a], f"[{KINDS[k]}]"]
                last = max(last, b)
            out.append(None if t is None else "".join([*parts, t[last:]]))
        yield {"doc_id": ids, "text": out}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, clean, f"doc_id {kind}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, digest of the rule spans, and all spans as text, from the result of ``find_spans``."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["origin"] == F.lit("rule"))
    return found.withColumn("base", base).select(
        "doc_id", *[F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
