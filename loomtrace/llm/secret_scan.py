"""Secret scans: three base patterns, and a linear-chain conditional random field.

The field tags all tokens of a line (words, signs, values) as begin, inside or outside of a secret, by
Viterbi. Features are the token's shape, the nearest trigger word before it and what lies between,
the word before it, and figures of the whole file. Weights are trained here, by gradient ascent on the
exact likelihood, over lines that TRAINING describes.

Most tokens are quiet: no digit, no unusual sign, not long, and no trigger word in reach. The weights
bound what a quiet token can add to a tagging that makes it part of a secret; if that is below what
being outside adds, quiet tokens further from all others than reach() tokens are outside in the best
tagging of the line, and only the stretches around the others are decoded. If the bound doesn't
hold, whole lines are decoded. Either way the tags are those of the whole line's best tagging.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import documents, slices, spread

#: Fixed by the contract.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ finds them
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

OUT, BEGIN, INSIDE = 0, 1, 2
#: Signs that part tokens, and tokens: such a sign, or a run of other characters with the = that may end it.
SIGNS = r"\s\"'`,;:|()<>\[\]{}="
TOKEN = re.compile(rf"[^{SIGNS}]+(?:={{1,2}}(?![^{SIGNS}]))?|[^\s]")
#: Words that announce secrets, and how many tokens they reach.
TRIGGERS = frozenset(
    "password passwd passphrase pwd pass secret secrets token tokens credential credentials apikey api_key key keys auth authorization bearer login".split()
)
REACH = 4
#: Tokens of at most so many characters are described once, while a worker remembers them.
SHORT = 40
#: Words whose successors are seldom secrets; features name them.
CUES = frozenset("commit sha256 md5 id version order card call phone on at file host see mail issue page line build isbn the a of is".split())
#: What makes a token other than quiet: a digit, a sign of codes, a capital after a small letter, more than LONG letters, a trigger word.
LONG = 20
LOUD = re.compile(
    r"[0-9_/+=@~^\\]|[a-z][A-Z]|[^\W\d_]{%d}|(?i:passw|passph|pwd|\bpass\b|secret|token|credential|api.?key|\bkeys?\b|\bauth|bearer|login)" % (
        LONG + 1
    )
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base patterns' matches, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api_key", "apikey")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the tokens of a line; marks that end a sentence don't belong to them."""
    out = []
    for m in TOKEN.finditer(text, start, end):
        a, b = m.span()
        while b - a > 1 and text[b - 1] in ".!?":
            b -= 1
        out.append((a, b))
    return out


def file_features(text: str) -> list[str]:
    """What the whole file looks like: code signs and key armour."""
    signs = sum(text.count(c) for c in "{};=")
    return [f"code:{min(3, int(math.log10(1 + 1000 * signs / (1 + len(text)))))}", f"armour:{'PRIVATE KEY' in text}"]


def _shape(token: str) -> str:
    """Kinds of characters, repetitions once; without digits only which kinds there are."""
    kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "_-./+=@" else "." for c in token[:64])
    if "0" in kinds:
        return "0 " + re.sub(r"(.)\1+", r"\1", kinds)[:6]
    return (
        "camel" if "aA" in kinds else "signs" if kinds.strip(".") == "" else "Word" if kinds[0] == "A"
        and "a" in kinds else "WORD" if "A" in kinds else "word"
    )


def own_features(token: str, near: bool) -> list[str]:
    """Features of a token alone; near: whether a trigger word before it is in reach. Sizes of plain words count near triggers only."""
    digits = any(c.isdigit() for c in token)
    sized = "digits" if digits else "near" if near else ""
    features = ["bias", f"shape:{_shape(token)}", f"at:{'@' in token[1:]}", f"plain:{token.isalpha()} {len(token) > LONG}"]
    if not sized:
        return [*features, "length:none", "entropy:none", "dots:none", "dashes:none", "slashes:none", "hex:none", "start:none"]
    entropy = -math.fsum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())
    return [
        *features,
        f"length:{min(10, len(token) // 4)} {sized}",
        f"entropy:{int(entropy * 2)} {sized}",
        f"dots:{min(3, token.count('.'))} {sized}",
        f"dashes:{min(4, token.count('-'))} {sized}",
        f"slashes:{min(3, token.count('/'))} {sized}",
        f"hex:{re.fullmatch('[0-9a-fA-F]+', token) is not None} {min(5, len(token) // 8)} {sized}",
        f"start:{token[:4]}" if digits and not token[:4].isdigit() else "start:none",
    ]


@lru_cache(maxsize=1 << 15)
def _remembered(token: str, near: bool) -> list[str]:
    return own_features(token, near)


def _kind(token: str) -> str:
    low = token.lower()
    return low if low in ("is", "was", "my", "the", "of") or len(token) == 1 else "word" if token.isalpha() else "other"


def line_features(words: list[str], whole: list[str]) -> list[list[str]]:
    """Names of the features of each token of a line."""
    low = [w.lower().strip("*-_.") for w in words]
    out = []
    for i, w in enumerate(words):
        near = next((d for d in range(1, min(REACH, i) + 1) if low[i - d] in TRIGGERS or low[i - d].split("_")[-1] in TRIGGERS), 0)
        before = low[i - 1] if i else ""
        said = ["trigger:none", "between:none"]
        if near:
            word = low[i - near].split("_")[-1]
            said = [f"trigger:{word}", f"between:{' '.join(_kind(x) for x in words[i - near + 1 : i])}"]
        out.append(
            [*(_remembered if len(w) <= SHORT else own_features)(w, near > 0), *said, f"cue:{before}" if before in CUES and not near else "cue:none", f"itself:{low[i] in TRIGGERS}", *whole]
        )
    return out


#: Training lines: (weight, template); a name in braces is generated below, and is a secret if the line has an exclamation mark
#: before the brace. The generators use one seeded random source, so that reruns train the same field.
TRAINING = (
    (3, 'password = "!{mixed}"'), (3, "api_key: !{mixed}"), (2, "token=!{hex40}"), (2, 'token = "!{hex40}"'), (2, "secret: !{hex32}"), (3, "password is !{short}"), (2, "my password is !{phrase}"),
    (3, "the password was !{signs} and"), (2, "pass !{short} works"), (2, "pwd: !{signs}"), (2, "passwd=!{short}"), (2, "password: !{phrase}"), (2, "login with !{short} or"), (2, 'secret "!{signs}"'),
    (2, "token is !{hex12}"), (2, "token !{mixed} expires"), (2, "use key !{mixed} now"), (2, "Authorization: Bearer !{jwt}"), (2, "bearer !{mixed}"), (2, "export SECRET_ACCESS_KEY=!{base64}"), (2, "DB_PASSWORD=!{signs}"),
    (2, "!{github}"), (2, "found !{github} there"), (2, "key !{stripe} was used"), (2, "see !{stripe}"), (2, "!{slack}"), (2, "aws_access_key_id = !{aws}"), (2, "client secret !{mixed}"), (2, "credentials !{short} here"), (2, "the passphrase is !{phrase}"),
    (3, "-----BEGIN RSA PRIVATE KEY-----\n!{base64}\n!{base64}\n!{base64}"), (2, "key: !{google}"), (1, "jwt !{jwt}"),
    (3, "see https://example.com/{path}"), (3, "mail {mail} or"), (3, "call {phone} today"), (3, "card {digits16} paid"), (3, "commit {hex40} fixed"), (3, "sha256 {hex64}"), (3, "id {uuid} seen"), (3, "version {version} of"), (2, "{date}"),
    (3, "on {date} it"), (3, "file {path} opened"), (2, "order number {digits16}"), (3, "host {host} is up"), (2, "{host}"), (3, "from {ip} to {ip}"), (2, "{mail}"), (3, "about {number} of {number}"), (2, "costs {number} in {year}"), (2, "Version 2.0, {year}"),
    (4, "the secret of {word} is {word}"), (3, "a secret {word} in the {word}"), (3, "password reset by {word}"), (3, "forgot the password {word}"), (3, "token count {number}"), (3, "each token {word} costs"), (3, "the key to {word}"), (2, "press the {word} key"),
    (2, "keys and {word}"), (2, "login page {number}"), (2, "auth service {word}"), (3, "key {word} value"), (3, "pass the {word}"), (2, "bearer of {word} news"), (3, "set {snake} to {number}"), (3, "call {camel} with {snake}"), (2, "{WORD} {WORD} {WORD}"), (2, "{word}### {word}%%% {word}!!"),
    (2, "{word} | {word} | {word}"), (2, "secret: {word} and {word}"), (2, "tokens: {number}"), (2, "license {version}"), (3, "{word} {long} {word}"), (2, "{word}-{word} {word}/{word}"), (2, "step {number}: {word}"), (2, "{number}. {word}"), (2, "ref {digits16}"),
)
COPIES, EPOCHS, RATE, PENALTY, SEED = 24, 60, 0.5, 2e-3, 7


def _generated(r: random.Random, name: str) -> str:
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    up, hexa = low.upper(), digits + "abcdef"
    every = low + up + digits
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    word = lambda: pick(low, r.randint(2, 10))
    mixed = lambda n: pick(every, n - 2) + r.choice(digits) + r.choice(up)
    return {
        "mixed": lambda: mixed(r.randint(12, 40)), "short": lambda: word() + pick(digits, r.randint(2, 4)) + pick(every, r.randint(0, 4)), "phrase": lambda: "".join(word() for _ in range(3)) + pick(low, 4),
        "signs": lambda: word().title() + r.choice("@!#$%&*") + pick(digits, r.randint(1, 4)) + r.choice("@!#$%&*") + word(), "hex12": lambda: pick(hexa, 11) + r.choice(digits), "hex32": lambda: pick(hexa, 32), "hex40": lambda: pick(hexa, 40), "hex64": lambda: pick(hexa, 64),
        "jwt": lambda: "eyJ" + pick(every, 20) + "." + pick(every, 40) + "." + pick(every + "_-", 30) + "1", "base64": lambda: pick(every + "+/", r.choice((40, 64))) + "9", "github": lambda: f"gh{r.choice('pousr')}_" + pick(every, 35) + "5", "stripe": lambda: f"sk_{r.choice(('live', 'test'))}_" + pick(every, 24) + "4",
        "slack": lambda: "xoxb-" + pick(digits, 11) + "-" + pick(every, 24), "aws": lambda: "AKIA" + pick(up + digits, 15) + "2", "google": lambda: "AIza" + pick(every + "_-", 34) + "8", "path": lambda: "/".join(word() for _ in range(3)) + f"/{r.randint(1, 99)}.html",
        "mail": lambda: f"{word()}.{r.choice((word(), str(r.randint(1, 99))))}@mail{r.randint(1, 9)}.{word()}.com", "phone": lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}", "digits16": lambda: pick(digits, r.choice((8, 12, 16))),
        "uuid": lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), "version": lambda: r.choice((f"release-{r.randint(1, 20)}.{r.randint(0, 99)}.{r.randint(0, 9)}", f"{r.randint(1, 20)}.{r.randint(0, 9)}", f"v{r.randint(1, 9)}")), "date": lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + r.choice(("", "T10:00", "T09:15:22Z")),
        "host": lambda: f"mail{r.randint(1, 99)}.{word()}.{word()}.com", "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "number": lambda: str(r.randint(0, 10 ** r.randint(1, 6))), "year": lambda: str(r.randint(1900, 2030)), "word": lambda: r.choice((word(), word().title(), word() + r.choice(",.!?"))), "WORD": lambda: word().upper(),
        "long": lambda: pick(low, r.randint(14, 26)), "snake": lambda: f"{word()}_{word()}", "camel": lambda: word() + word().title(),
    }[name]()


def drawn(r: random.Random, template: str) -> tuple[str, list[tuple[int, int]]]:
    """A line of a template, and the spans of its secrets."""
    text, secrets = "", []
    for part in re.split(r"(!?\{\w+\})", template):
        if re.fullmatch(r"!?\{\w+\}", part):
            value = _generated(r, part.strip("!{}"))
            if part[0] == "!":
                secrets.append((len(text), len(text) + len(value)))
            part = value
        text += part
    return text, secrets


def training_chains() -> list[tuple[list[list[str]], list[int]]]:
    """Feature names and tags of the generated lines."""
    r, out = random.Random(SEED), []
    for weight, template in TRAINING:
        for _ in range(weight * COPIES):
            text, secrets = drawn(r, template)
            some = lambda: " ".join(_generated(r, "word") for _ in range(r.randint(0, 4)))
            before = some()
            text, at = f"{before} {text} {some()}", len(before) + 1  # neighbours that say nothing
            secrets = [(a + at, b + at) for a, b in secrets]
            whole = file_features(text)
            for start, end in lines(text):
                spans = tokens(text, start, end)
                inside = [next((k for k, (a, b) in enumerate(secrets) if a <= s < b), None) for s, _ in spans]
                tags = [OUT if k is None else INSIDE if j and inside[j - 1] == k else BEGIN for j, k in enumerate(inside)]
                if spans:
                    out.append((line_features([text[a:b] for a, b in spans], whole), tags))
    return out


def lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, end
        at = end + 1


#: Moves between tags that cannot be: inside after outside, and at a line's start.
_MOVES = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
_FIRST = np.array([0.0, 0.0, -1e9])


def marginals(emit: np.ndarray, there: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags of all chains, and expected moves, by forward-backward; emit is (chain, place, tag), there says which places a chain has.

    Sums are scaled at each place. None gets to 0, as RATE and EPOCHS bound each weight by 8 and a place's scores by 250 of each other.
    """
    n = emit.shape[1]
    scaled = lambda x: x / x.sum(1, keepdims=True)
    like, step = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves)
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = scaled(like[:, 0] * np.exp(_FIRST))
    for i in range(1, n):
        ahead[:, i] = np.where(there[:, i, None], scaled((ahead[:, i - 1] @ step) * like[:, i]), ahead[:, i - 1])
    pairs = np.zeros((3, 3))
    for i in range(n - 2, -1, -1):
        onward = like[:, i + 1] * back[:, i + 1]
        share = there[:, i + 1] / ((ahead[:, i] @ step) * onward).sum(1)
        pairs += step * ((ahead[:, i] * share[:, None]).T @ onward)
        back[:, i] = np.where(there[:, i + 1, None], scaled(onward @ step.T), 1.0)
    both = ahead * back
    return both / both.sum(2, keepdims=True) * there[:, :, None], pairs


@dataclass(frozen=True)
class Model:
    """Feature names with their numbers, weights (feature, tag; unknown features are row 0, all 0), and weights of moves (tag, tag)."""

    names: dict[str, int]
    emit: np.ndarray
    moves: np.ndarray

    def scores(self, described: list[list[str]]) -> np.ndarray:
        return self.emit[[[self.names.get(f, 0) for f in xs] for xs in described]].sum(1)

    def most(self, of: np.ndarray, allowed: Callable[[str], bool]) -> float:
        """The most that the features of a token add up to, whose names are allowed: one value of each kind, or an unknown one."""
        by_kind: dict[str, float] = {}
        for name, k in self.names.items():
            kind = name.split(":")[0]
            if allowed(name):
                by_kind[kind] = max(by_kind.get(kind, -math.inf if kind in ALWAYS else 0.0), float(of[k]))
        return sum(by_kind.values())

    def reach(self) -> int | None:
        """How many quiet tokens part stretches whose tags don't depend on each other; None if quiet tokens may be in secrets.

        k quiet tokens in a secret instead of outside add at most k * gain by their features and
        (k + 1) * spread by moves; where they join two secrets, the second one's first token adds at most `join`.
        """
        can = self.moves[_MOVES == 0]
        spread = float(can.max() - can.min())
        worst = self.most(self.emit[:, 1:].max(1) - self.emit[:, OUT], quiet_value) + 2 * spread
        join = self.most(self.emit[:, INSIDE] - self.emit[:, BEGIN], lambda _: True)
        return None if worst >= 0 else REACH + 2 + math.ceil(max(0.0, join) / -worst)


#: Kinds of features of which every quiet token has one of the known values.
ALWAYS = (
    "bias",
    "shape",
    "at",
    "plain",
    "length",
    "entropy",
    "dots",
    "dashes",
    "slashes",
    "hex",
    "start",
    "trigger",
    "between",
    "cue",
    "itself",
    "armour",
)


def quiet_value(name: str) -> bool:
    """Whether a quiet token, out of reach of triggers, can have a feature."""
    kind, _, value = name.partition(":")
    if kind in ("bias", "cue", "code", "armour"):
        return True
    if kind == "shape":
        return value in ("signs", "word", "Word", "WORD")
    return value == "none" or kind in ("at", "itself", "plain") and value.endswith("False")


@lru_cache(maxsize=1)
def trained() -> Model:
    data = training_chains()
    names = {f: i + 1 for i, f in enumerate(dict.fromkeys(f for xs, _ in data for x in xs for f in x))}
    longest = max(len(xs) for xs, _ in data)
    kinds: dict[tuple[str, ...], int] = {}  # tokens described alike are scored once
    numbers = np.zeros((len(data), longest), np.int64)
    gold, there = np.zeros((len(data), longest, 3)), np.zeros((len(data), longest), bool)
    pairs_gold = np.zeros((3, 3))
    for k, (xs, tags) in enumerate(data):
        numbers[k, : len(xs)] = [kinds.setdefault(tuple(x), len(kinds)) for x in xs]
        gold[k, range(len(tags)), tags] = 1
        there[k, : len(xs)] = True
        np.add.at(pairs_gold, (tags[:-1], tags[1:]), 1)
    used = np.array([[names[f] for f in x] for x in kinds])
    width, each = used.shape[1], numbers[there]
    emit, moves = np.zeros((len(names) + 1, 3)), _MOVES.copy()
    squares, squares_m = np.full_like(emit, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(EPOCHS):
        expected, pairs = marginals(emit[used].sum(1)[numbers] * there[:, :, None], there, moves)
        off = (gold - expected)[there]
        by_kind = [np.bincount(each, off[:, t], len(used)) for t in range(3)]
        grad = np.column_stack([np.bincount(used.ravel(), np.repeat(x, width), len(emit)) for x in by_kind])
        grad -= PENALTY * len(each) * emit / 100
        grad_m = pairs_gold - pairs
        squares += grad**2
        squares_m += grad_m**2
        emit += RATE * grad / np.sqrt(squares)
        moves = np.where(_MOVES < 0, _MOVES, moves + RATE * grad_m / np.sqrt(squares_m))
    emit[0] = 0
    return Model(names, emit, moves)


def viterbi(emit: np.ndarray, moves: np.ndarray) -> list[int]:
    """The likeliest tags of a chain; of equal ones the lower tag."""
    best, back = (emit[0] + _FIRST).tolist(), []
    into = moves.T.tolist()  # by the tag that a move leads to
    for e in emit[1:].tolist():
        through = [[b + m for b, m in zip(best, row, strict=True)] for row in into]
        best = [max(x) for x in through]
        back.append([x.index(top) for x, top in zip(through, best, strict=True)])
        best = [b + x for b, x in zip(best, e, strict=True)]
    tags = [best.index(max(best))]
    for b in reversed(back):
        tags.append(b[tags[-1]])
    return tags[::-1]


def stretches(text: str, reach: int | None) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Lines with anything loud in them: their tokens, and which of these to decode together, first and last but one."""
    at = 0
    while hit := LOUD.search(text, at):
        start, end = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.start())
        end = len(text) if end < 0 else end
        spans = tokens(text, start, end)
        if reach is None:
            yield spans, 0, len(spans)
        else:
            loud = sorted(
                {max(0, bisect_left(spans, (m.start() + 1,)) - 1) for m in LOUD.finditer(text, start, end)}
                | {min(len(spans) - 1, max(0, bisect_left(spans, (m.end(),)) - 1)) for m in LOUD.finditer(text, start, end)}
            )
            first = last = None
            for k in loud:
                if first is not None and k - reach > last:
                    yield spans, first, last
                    first = None
                first, last = max(0, k - reach) if first is None else first, min(len(spans), k + reach + 1)
            if first is not None:
                yield spans, first, last
        at = end


def field_spans(text: str, model: Model, reach: int | None) -> list[tuple[int, int]]:
    """Spans of the secrets that the field finds in a text."""
    found: list[tuple[int, int]] = []
    whole = None
    for spans, first, last in stretches(text, reach):
        whole = whole or file_features(text)
        back = max(0, first - REACH)  # the features of a token look so far back
        described = line_features([text[a:b] for a, b in spans[back:last]], whole)[first - back :]
        scores = model.scores(described)
        scores[: first > 0, 1:] = scores[len(scores) - (last < len(spans)) :, 1:] = -1e9  # quiet tokens far from others are outside
        for (a, b), tag in zip(spans[first:last], viterbi(scores, model.moves), strict=True):
            if tag == BEGIN:
                found.append((a, b))
            elif tag == INSIDE:
                found[-1] = (found[-1][0], b)
    return found


def all_spans(text: str, model: Model, reach: int | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the field's are added where they touch no base span."""
    base = base_spans(text)
    starts, ends = [s for _, s, _ in base], list(accumulate((e for *_, e in base), max))
    added = []
    for a, b in field_spans(text, model, reach):
        before = bisect_left(starts, b)  # base spans that start before b
        if not before or ends[before - 1] <= a:
            added.append(("crf", a, b))
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model.reach()
        for batch in (x for whole in batches for x in slices(whole)):
            counts, shas, spans = {k: [] for k in KINDS}, [], []
            for x in batch.column(1).to_pylist():
                base, every = all_spans(x or "", model, reach)
                for k in KINDS:
                    counts[k].append(sum(kind == k for kind, _, _ in every))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                ["row", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans for every row of docs.

    Null and empty texts hold no secrets; rows are independent of each other; further columns are
    not read. The field's weights are a fixed-size table, trained on the driver before the job.
    """
    rows = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)))
    schema = "row long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return rows.mapInArrow(_scan(trained()), schema).withColumnRenamed("row", "doc_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir, "doc_id", "text"))
