"""Personal data by a skip-chain conditional random field over candidate tokens.

Patterns give the base spans, which always stay.  Looser patterns give further
candidates: numbers written another way, addresses with "(at)".  All candidates
of a document are the nodes of a random field with labels none, email, ip, card
and phone.  Features tell of a candidate's shape and of cue words before it.
Neighbours in the text share chain potentials; candidates that repeat or resemble
each other, however far apart, share skip potentials, each with the next and with
a base span among them.  Loopy message passing with the base spans held fixed
judges every candidate and carries labels to the other mentions until the messages
settle, so that an entity is labelled alike throughout a document.

Weights are learned by pseudo-likelihood from all documents, on planted variants
(:func:`plant`): some base spans are written in another dress behind a cue word,
some get a second mention elsewhere, and decoys of the same dress but another
content, without cue or tie, stand for none.  So dress alone is not enough.

All scanning is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
# Words that announce a kind, in four languages.
CUES = {
    "email": "mail email e-mail write contact reach schreib schreiben courriel correo escribe",
    "ip": "ip host server address addr ping adresse rechner serveur servidor",
    "card": "card visa credit debit pay karte kreditkarte carte tarjeta",
    "phone": "call phone tel telephone ring mobile fax sms anruf telefon anrufen appel appeler llama teléfono",
}
CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}
#: Characters before a candidate in which a cue word counts.
AHEAD = 40
#: Posterior from which a candidate is added.
SURE = 0.9
#: Characters between candidates that share a chain potential.
CHAIN = 60
#: Messages have settled when none changes by more; every so many sweeps without that, they are damped twice as much, at most so often.
SETTLED, SWEEPS, DAMPINGS = 1e-4, 200, 5
BATCH = 128

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./()_-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[.,_-]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])")
_AT = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20")
_LOOSE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,8}")
_DOT = re.compile(r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20")
_RUN = 256
#: What any candidate holds; a text without it has none.
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]|\x20at\x20")


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Each @ decides for itself: the run before it, back to the last match, and the domain behind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free and (m := _DOMAIN.match(text, at)):
            start, step = at, _RUN
            while True:
                low = max(free, start - step)
                begin = _LOCAL.search(text, low, start).start() if start > low else start
                moved, start = begin == low and low > free, begin
                if not moved:
                    break
                step *= 2
            if start < at:
                out.append(("email", start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches of all kinds, by start, then kind; code points, end exclusive."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _loose(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that do not touch a base span, by start; of overlapping ones the first stays."""
    out = []
    for m in _AT.finditer(text):
        left = _LOOSE_LOCAL.search(text, max(0, m.start() - 64), m.start())
        right = _LOOSE_DOMAIN.match(text, m.end())
        if left and right:
            out.append(("email", left.start(), right.end()))
    out += [("ip", m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
    out += [("number", m.start(), m.end()) for m in _LOOSE_NUMBER.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    kept, end, k = [], -1, 0
    for kind, a, b in sorted(out, key=lambda s: (s[1], -s[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= end and not (k < len(taken) and taken[k][0] < b):
            kept.append((kind, a, b))
            end = b
    return kept


FEATURES = [
    "one", "at", "at_mark", "at_word", "dotted", "small_parts", "plus", "luhn", "d7", "d9", "d12", "d16", "spaced", "grouped", "fours", "odd_marks",
    "cue_email", "cue_ip", "cue_card", "cue_phone",
]
_GROUPED, _FOURS = re.compile(r"(?:[0-9]{1,3}[^0-9]+)?[0-9]{3}[^0-9]+[0-9]{3}[^0-9]+[0-9]{4}\Z"), re.compile(r"[0-9]{4}(?:[^0-9][0-9]{4}){3}\Z")
_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def cues(text: str, at: int) -> set[str]:
    """Kinds that one of the last three words before a place announces."""
    return {CUE_OF[w] for w in _LETTERS.findall(text[max(0, at - AHEAD) : at].lower())[-3:] if w in CUE_OF}


class Graph:
    """Candidates of one text with features, chain edges and skip edges."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.nodes = sorted([(a, b, k, True) for k, a, b in base] + [(a, b, k, False) for k, a, b in _loose(text, base)])
        self.x = np.zeros((len(self.nodes), len(FEATURES)))
        groups = defaultdict(list)
        for i, (a, b, kind, _) in enumerate(self.nodes):
            s = text[a:b]
            d = _digits(s)
            parts = re.split(r"\x20?[.,_-]\x20?", s)
            quad = len(parts) == 4 and all(map(str.isdecimal, parts))
            mail = "@" in s or kind == "email"
            told = cues(text, a)
            self.x[i] = [
                1, "@" in s, kind == "email" and "@" not in s and ("(" in s or "[" in s), kind == "email" and "@" not in s and not ("(" in s or "[" in s), quad, quad and all(int(p[-4:]) <= 255 for p in parts),
                s[0] == "+", len(d) >= 12 and luhn(d), 7 <= len(d) < 9, 9 <= len(d) < 12, 12 <= len(d) < 16, 16 <= len(d) < 20, " " in s,
                _GROUPED.match(s) is not None, _FOURS.match(s) is not None, not mail and any(c in s for c in ",_/"), *[k in told for k in KINDS],
            ]
            if mail:
                name = _AT.sub("@", s, 1) if "@" not in s else s
                groups["mail", _DOT.sub(".", name).lower()].append(i)
                groups["local", name.partition("@")[0].lower()].append(i)
            else:
                if quad:
                    groups["quad", ".".join([p.lstrip("0") or "0" for p in parts])].append(i)
                if len(d) >= 9 or (len(d) >= 7 and not quad):
                    groups["tail", d[-7:]].append(i)
        self.ties = sorted({(a, b) for g in groups.values() for a, b in zip(g, g[1:])})
        # and each mention to the first base node of every kind in its group, or to the first mention of a group without
        hubs = [(g, {self.nodes[i][2]: i for i in reversed(g) if self.nodes[i][3]}.values() or g[:1]) for g in groups.values()]
        self.skip = sorted({(min(h, i), max(h, i)) for g, first in hubs for h in first for i in g if h != i} | set(self.ties))
        self.chain = [(i, i + 1) for i in range(len(self.nodes) - 1) if self.nodes[i + 1][0] - self.nodes[i][1] <= CHAIN]
        self.fixed = np.array([ORDER[k] + 1 if known else 0 for _, _, k, known in self.nodes], np.int64)


class SkipChainField:
    """Unary, chain and skip weights; symmetric pair weights over the five labels."""

    def __init__(self):
        self.unary = np.zeros((len(FEATURES), 5))
        self.chain, self.skip = np.zeros((5, 5)), self.prior_skip()

    @staticmethod
    def prior_skip() -> np.ndarray:
        """Before any data: two mentions of one content agree, on none as on a kind."""
        return np.diag([3.0, 3.0, 3.0, 3.0, 3.0])

    def fit(self, x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, many: np.ndarray | None = None, steps: int = 600, ridge: float = 0.5) -> SkipChainField:
        """Pseudo-likelihood: each node given its neighbours' labels, by gradient ascent with momentum; row i stands for many[i] nodes."""
        if not len(y):
            return self
        target = np.eye(5)[y]
        many = np.ones(len(y)) if many is None else many.astype(float)
        # classes weigh alike in sum, so a corpus with few mentions teaches the same as one with many
        share = np.bincount(y, many, 5)
        many = many * (many.sum() / (share > 0).sum() / share[y])
        velocity = [np.zeros_like(w) for w in (self.unary, self.chain, self.skip)]
        for _ in range(steps):
            z = x @ self.unary + chain @ self.chain + skip @ self.skip
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            r = (target - p) * many[:, None]
            grads = [x.T @ r - ridge * self.unary, chain.T @ r - ridge * self.chain, skip.T @ r - ridge * (self.skip - self.prior_skip())]
            for k, name in enumerate(("unary", "chain", "skip")):
                g = grads[k] if not k else (grads[k] + grads[k].T) / 2
                velocity[k] = 0.9 * velocity[k] + g * (1.0 / many.sum())
                setattr(self, name, getattr(self, name) + velocity[k])
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product with base nodes held at their kinds."""
        m = len(graph.nodes)
        local = graph.x @ self.unary
        held = graph.fixed > 0
        local[held] = -1e9
        local[held, graph.fixed[held]] = 0
        pairs = [(a, b, 0) for a, b in graph.chain] + [(a, b, 1) for a, b in graph.skip]
        if pairs:
            src = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
            dst = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            weight = np.stack([self.chain, self.skip])[np.array([p[2] for p in pairs] * 2)]
            messages = np.zeros((len(src), 5))
            step = 0.5
            for sweep in range(1, SWEEPS * DAMPINGS + 1):
                total = local.copy()
                np.add.at(total, dst, messages)
                out = (total[src] - messages[back])[:, :, None] + weight
                top = out.max(axis=1, keepdims=True)
                fresh = (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0, :]
                fresh -= fresh.max(axis=1, keepdims=True)
                moved = np.abs(fresh - messages).max()
                messages = (1 - step) * messages + step * fresh
                if moved <= SETTLED:
                    break
                if sweep % SWEEPS == 0:
                    step /= 2
            np.add.at(local, dst, messages)
        local -= local.max(axis=1, keepdims=True) if m else 0
        p = np.exp(local)
        return p / p.sum(axis=1, keepdims=True)


def _dressed(kind: str, s: str, how: int) -> str:
    """The content of a base span in one of its other dresses."""
    if kind == "email":
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "))[how % 3]
        local, _, domain = s.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return (",", " . ", "_", "-")[how % 4].join([p.lstrip("0")[-3:] or "0" for p in s.split(".")])
    d = _digits(s)
    if kind == "card":
        return "._/"[how % 3].join([d[k : k + 4] for k in range(0, len(d), 4)])
    d = d[-10:]
    return (f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[:-7]} {d[-7:-4]} {d[-4:]}", f"{d[:-7]}/{d[-7:-4]}-{d[-4:]}", f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}")[how % 4]


def _other(kind: str, s: str, how: int) -> str:
    """A content of the same form that is not the span's: what a decoy shows."""
    if kind == "email":
        local, _, domain = s.partition("@")
        return f"q{how % 97}{local[::-1]}@z{domain}"
    step = 1 + how % 8
    turned = "".join([str((int(c) + step + i) % 10) if "0" <= c <= "9" else c for i, c in enumerate(s)])
    return ".".join([str(int(p) % 250) for p in turned.split(".")]) if kind == "ip" else turned


def plant(text: str, base: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with planted variants, and (kind or "none", start, end) of each; what happens follows from the text alone.

    Of four base spans, about one is left, one replaced by another dress behind a
    cue word, one mentioned again in another dress some way behind or at the end,
    and one gets a decoy there, every other time twice, for repeats alone tell
    nothing either.  Spans that overlap one before are left.
    """
    seed, edits, last = zlib.crc32(text.encode("utf-8", "replace")), [], -1
    for k, (kind, a, b) in enumerate(base):
        if a < last:
            continue
        last = b
        draw = zlib.crc32(f"{seed}:{k}".encode())
        way, how = draw % 4, draw >> 8
        s = text[a:b]
        if way == 1:
            words = CUES[kind].split()
            edits.append((a, b, words[how % len(words)] + " ", _dressed(kind, s, how >> 4), kind))
        elif way > 1:
            at = text.find(" ", b + 90 + how % 400)
            at = len(text) if at < 0 else at
            if way == 2:
                edits.append((at, at, " ", _dressed(kind, s, how >> 4), kind))
                continue
            decoy = _other(kind, s, how)
            again = text.find(" ", at + 60)
            edits.append((at, at, " ", _dressed(kind, decoy, how >> 4), "none"))
            if how % 2:
                edits.append(((place := len(text) if again < 0 else again), place, " ", _dressed(kind, decoy, how >> 5), "none"))
    out, spans, at, size = [], [], 0, 0
    for a, b, before, s, kind in sorted(edits):
        if a < at:
            continue
        head = text[at:a] + before
        size += len(head)
        spans.append((kind, size, size + len(s)))
        out += [head, s]
        size += len(s)
        at = b
    return "".join([*out, text[at:]]), spans


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of candidates beside the base spans: features, neighbours' label counts, label.

    Planted variants have their labels, other candidates none, except those tied
    to a mention: their label is open, and they are left out.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            seen: Counter = Counter()
            for text in whole.column("text").slice(at, BATCH).to_pylist():
                text = text or ""
                made, planted = plant(text, base_spans(text))
                g = Graph(made, base_spans(made))
                label, k = g.fixed.copy(), 0
                for i, (a, b, _, known) in enumerate(g.nodes):
                    while k < len(planted) and planted[k][2] <= a:
                        k += 1
                    if not known and k < len(planted) and planted[k][1] < b:
                        label[i] = ORDER[planted[k][0]] + 1 if planted[k][0] in ORDER else -2
                tied = np.zeros(len(label), bool)
                for a, b in g.skip:
                    tied[a] |= label[b] > 0
                    tied[b] |= label[a] > 0
                label[(label == 0) & tied] = -1
                label[label == -2] = 0
                near = np.zeros((2, len(label), 5), int)
                for kind, edges in ((0, g.chain), (1, g.skip)):
                    for a, b in edges:
                        if label[b] >= 0:
                            near[kind, a, label[b]] += 1
                        if label[a] >= 0:
                            near[kind, b, label[a]] += 1
                for i, (_, _, _, known) in enumerate(g.nodes):
                    if not known and label[i] >= 0:
                        seen[(*g.x[i].astype(int).tolist(), *near[0, i].tolist(), *near[1, i].tolist(), int(label[i]))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in seen], pa.list_(pa.int64())), pa.array(list(seen.values()), pa.int64())], ["row", "many"])


def fit_field(docs: DataFrame) -> SkipChainField:
    """Weights from all documents that may hold a candidate.

    Equal rows are counted where they arise and combined before the shuffle.
    Only their distinct kinds with counts reach the driver; these are patterns of
    yes-no features and of small neighbour counts, not documents.  Null texts have
    no candidates, and an empty table gives the field as it is before any data.
    """
    texts = docs.select("text").where(F.col("text").rlike(_ANY.pattern))
    counted = texts.mapInArrow(_training_rows, "row array<long>, many long").groupBy("row").agg(F.sum("many").alias("many")).collect()
    if not counted:
        return SkipChainField()
    got = np.array(sorted((*r.row, r.many) for r in counted), float)
    k = len(FEATURES)
    return SkipChainField().fit(got[:, :k], got[:, -2].astype(int), got[:, k : k + 5], got[:, k + 5 : k + 10], got[:, -1])


def measured(docs: Iterator[str], field: SkipChainField) -> dict[str, tuple[int, int, int]]:
    """Of planted texts by kind: variants planted, variants found as their kind, spans added beside any."""
    out = {k: [0, 0, 0] for k in KINDS}
    for text in docs:
        made, planted = plant(text, base_spans(text))
        base, every = spans_of(made, field)
        added = [s for s in every if s not in set(base)]
        want = [s for s in planted if s[0] in ORDER and not any(a < s[2] and s[1] < b for _, a, b in base)]
        hit = lambda s, others: any(k == s[0] and a < s[2] and s[1] < b for k, a, b in others)
        for s in want:
            out[s[0]][0] += 1
            out[s[0]][1] += hit(s, added)
        for s in added:
            out[s[0]][2] += not hit(s, want)
    return {k: tuple(v) for k, v in out.items()}


def spans_of(text: str, field: SkipChainField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that the field adds."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    graph = Graph(text, base)
    if len(graph.nodes) == len(base):
        return base, base
    p = field.marginals(graph)
    added = [(KINDS[int(p[i, 1:].argmax())], a, b) for i, (a, b, _, known) in enumerate(graph.nodes) if not known and p[i, 1:].max() >= SURE]
    return base, sorted(base + added, key=lambda s: (s[1], ORDER[s[0]]))


def find_pii(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the base spans; spans also holds those
    that the field adds.  Null texts are empty and have no spans.  Texts of any
    length are judged whole, with all their candidates in one field.  Repeated
    rows are judged each; other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                out = []
                for text in batch.column("text").to_pylist():
                    base, every = spans_of(text or "", field)
                    counts = [sum(1 for s in base if s[0] == k) for k in KINDS]
                    out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return find_pii(docs, fit_field(docs))
