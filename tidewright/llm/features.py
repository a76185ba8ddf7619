"""Dense features of whole texts, shared by the toxicity and quality models.

Only the text is read: no label, language, source or id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import eq

import numpy as np

# Common insults, pronouns of the second person, and function words, by language.
INSULTS = frozenset(
    """idiot idiots stupid moron morons loser losers trash scum worthless pathetic disgusting clown dumb fool garbage filth
    vermin imbecile jerk coward parasite freak creep hate kill shut
    idioten dumm dummkopf abschaum versager widerlich ekelhaft trottel arschloch
    imbécile crétin ordure minable dégoûtant abruti connard
    idiota estúpido estúpida basura imbécil asqueroso patético inútil""".split()
)
SECOND_PERSON = frozenset(
    """you your yours yourself u ur du dich dir dein deine deinen euch euer tu te toi ton ta tes vous votre vos
    tú ti usted ustedes vosotros""".split()
)
FUNCTION_WORDS = frozenset(
    """the of and to in a is that it for on was be with as by this from at are or an not
    der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    de la le les et des en un une du que est pour dans qui par sur pas au avec
    el los las y se del por con no una su para es al lo como más""".split()
)

_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\r", 4), (b"\n", 5), (b".,;:", 6), (b"!", 7), (b"?", 8), (b"#$%&*+=@^~_\\/<>{}[]|", 9), (b"'\"()-`", 10)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:192] = 11
_CLASS[192:] = 12

_TOKEN = re.compile(r"[\w*@$!]*\w[\w*@$]*")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_LEET = str.maketrans("013457@$!", "oieastasi")

SURFACE = [
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "unique_share", "top_share", "repeat_next", "upper_rate", "shout_share",
    "digit_rate", "mark_rate", "bang_rate", "question_rate", "symbol_rate", "quote_rate", "wide_rate", "lines_per_word", "twin_lines", "short_lines",
    "open_ends", "function_share", "squeeze", "bare_tokens", "letter_share",
]


def surface(text: str) -> list[float]:
    """The features named in SURFACE; zeros for an empty text."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n = len(words)
    if not n:
        return [math.log1p(len(raw)), *[0.0] * (len(SURFACE) - 1)]
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=13).tolist()
    size = len(raw)
    chars = size - kinds[11]
    lengths = np.fromiter(map(len, words), np.int64, n)
    low = text.lower().split()
    counts = Counter(low)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    m = max(1, len(lines))
    letters = kinds[1] + kinds[2] + kinds[12]
    shout = sum(1 for w in words if len(w) > 1 and w.isupper())
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())), len(counts) / n,
        max(counts.values()) / n, sum(map(eq, low, low[1:])) / n, kinds[1] / max(1, letters), shout / n,
        kinds[3] / chars, kinds[6] / n, kinds[7] / n, kinds[8] / n, kinds[9] / n, kinds[10] / n, kinds[12] / chars, m / n,
        1 - len(set(lines)) / m, sum(1 for x in lines if len(x) < 30) / m, sum(1 for x in lines if x[-1] not in ".!?:\"") / m,
        sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n, len(zlib.compress(raw, 1)) / size,
        sum(1 for w in words if not any(map(str.isalnum, w))) / n, letters / chars,
    ]


TOXIC = [
    "insult_rate", "insult_count", "hidden_rate", "learned_sum", "learned_rate", "learned_top", "learned_distinct", "strong_rate", "strong_count", "learned_mean", "learned_per_root", "person_rate", "person_near", "upper_rate",
    "shout_share", "bang_rate", "question_rate", "star_rate", "leet_rate", "stretch_rate", "log_words",
]
#: Words this far from a second person count as addressed.
NEAR = 12
#: Weight from which an entry of the learned lexicon counts as strong.
STRONG = 2.5


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def stems(word: str) -> list[str]:
    """What the lexicon is learned over: the word, and beginnings that inflected forms share."""
    return [word, *["^" + word[:k] for k in (5, 6, 7) if len(word) > k]]


def toxic(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features named in TOXIC; lexicon holds weights of words, and of beginnings marked by ^."""
    words = tokens(text)
    n = len(words)
    if not n:
        return [0.0] * len(TOXIC)
    person, hits, weights, hidden, leet, found = [], [], [], 0, 0, set()
    memo: dict[str, tuple[bool, float, bool, bool]] = {}
    for i, w in enumerate(words):
        known = memo.get(w)
        if known is None:
            plain = w.strip("!*@$_")
            weight = max([lexicon.get(s, 0.0) for s in stems(plain)], default=0.0)
            mixed = not plain.isalpha() and any(map(str.isalpha, plain))
            read = plain.translate(_LEET).replace("*", "") if mixed else plain
            veiled = mixed and (read in INSULTS or lexicon.get(read, 0.0) > 0)
            known = memo[w] = (plain in INSULTS or veiled, weight, veiled, mixed and any(map(str.isdigit, plain)))
        if w in SECOND_PERSON:
            person.append(i)
        if known[0] or known[1] > 0:
            hits.append((i, known[0]))
            weights.append(known[1])
            found.add(w)
        hidden += known[2]
        leet += known[3]
    insults = sum(1 for _, fixed in hits if fixed)
    near = 0.0
    if person and hits:
        at = np.array(person)
        for i, _ in hits:
            k = int(np.searchsorted(at, i))
            d = min([abs(i - int(at[j])) for j in (k - 1, k) if 0 <= j < len(at)])
            near += 1 / (1 + d) if d <= NEAR else 0.0
    learned = [w for w in weights if w > 0]
    strong = [w for w in learned if w > STRONG]
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=13).tolist()
    upper, letters = kinds[1], kinds[1] + kinds[2] + kinds[12]  # every character beyond ASCII counts as a letter
    plain_words = text.split()
    shout = sum(1 for w in plain_words if len(w) > 1 and w.isupper())
    return [
        100 * insults / n, math.log1p(insults), 100 * hidden / n, math.log1p(sum(learned)), 100 * len(learned) / n, max(learned, default=0.0), math.log1p(len(found)),
        100 * len(strong) / n, math.log1p(len(strong)), sum(learned) / max(1, len(learned)), sum(learned) / math.sqrt(n),
        100 * len(person) / n, near, upper / max(1, letters), shout / max(1, len(plain_words)), text.count("!") / n, text.count("?") / n,
        (text.count("*") + text.count("$") + text.count("@")) / n, leet / n, len(_STRETCH.findall(text)) / n, math.log1p(n),
    ]
