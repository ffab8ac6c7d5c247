"""Personal data by weak supervision.

Candidates are spans of a loose shape: of the four base kinds before their
checks, and of further kinds. Labelers (shape, checksum, gazetteer, context that
speaks for it, context that speaks against it, surroundings) vote personal, not,
or nothing. Expectation-maximisation over the counts of all vote patterns
estimates how reliable each labeler is on each kind; its posteriors
train a logistic classifier over votes, span and context. Spans of the base
kinds that pass their checks always stay; the classifier decides on the rest.

Defined results: null and empty texts have no spans; repeated rows are judged
one by one; texts of any length are scanned in linear time; of spans of further
kinds those inside a base span go; an empty table gives no rows; columns other
than id and text never matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "local_phone", "obfuscated_email", "person", "secret", "ssn")
KINDS = (*BASE, *MORE)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run matches from its first digit or not at all; the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z_-]{2,40})[ \t]{0,3}[=:][ \t]{0,3}[\"']([^\"'\s]{8,200})[\"']")
_OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}){1,4}")
#: Secrets without quotation marks only behind a name that says so.
_BARE = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z_-]{0,40}(?:token|secret|password|passwd|pwd|key|auth|credentials?))[ \t]{0,3}[=:][ \t]{0,3}([A-Za-z0-9_+/.~!@#$%^&*-]{8,200})(?![^\s,;)\]}])", re.IGNORECASE)
_NAME = r"(?:[A-Z]['’])?[^\W\d_a-zß-öø-ÿ][^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]{0,30}(?:-[^\W\d_]{1,30})?"
_TITLED = re.compile(rf"(?<!\w)(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? {_NAME}(?: {_NAME}){{0,2}}(?!\w)")
#: Phrases of the four languages that a full name follows.
INTRODUCTIONS = ("my name is", "name is", "name:", "i am", "i'm", "signed", "signed by", "sincerely", "sincerely,", "regards,", "dear", "contact", "contact:", "attn:", "written by", "author:", "patient:", "ask for", "speak to", "speak with", "je m'appelle", "mon nom est", "cher", "chère", "signé", "signé par", "ich heiße", "mein name ist", "liebe", "lieber", "gezeichnet", "me llamo", "mi nombre es", "estimado", "estimada", "querido", "querida", "firmado", "firmado por")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")
_NAMED = ("token", "secret", "passw", "pwd", "key", "auth", "credential")
_INTRODUCED = re.compile(rf"(?<!\w)(?:(?i:{'|'.join(map(re.escape, sorted(INTRODUCTIONS, key=len, reverse=True)))}))[ \t\n]{{1,2}}({_NAME}(?: (?:[A-Z]\. )?{_NAME}){{1,2}})(?!\w)")
_PERSON = re.compile(r"(?<!\w)(?:(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? )?[A-ZÀ-Ý][a-zà-ÿ]{1,30} (?:[A-Z]\. )?[A-ZÀ-Ý][a-zà-ÿ]{1,30}(?!\w)")
_HONORIFIC = re.compile(r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ")

#: Names of keys that hold credentials; placeholders of documentation; reserved domains.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "credential", "private_key")
PLACEHOLDERS = ("example", "placeholder", "changeme", "your_", "your-", "xxxx", "dummy", "sample", "<", "{", "http", "/", "1234")
RESERVED = ("test", "invalid", "localhost", "local", "png", "jpg", "jpeg", "gif", "svg", "webp", "js", "css", "html", "py")
#: Generic top-level domains; every two letters count as a country's.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "io", "online", "site", "shop", "cloud", "tech", "xyz")
#: First digits of card numbers; calling codes of one and two digits, and beginnings of those of three; countries of account numbers.
CARDS = ("34", "37", "36", "38", "30", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65", "35")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
ACCOUNTS = ("AD", "AE", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IL", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SA", "SE", "SI", "SK", "SM", "TR", "UA")
#: Frequent given names of the four languages.
GIVEN = ("Alice", "Andrea", "Andrew", "Ángel", "Anna", "Anne", "Antoine", "Antonio", "Barbara", "Brian", "Camille", "Carlos", "Carmen", "Catherine", "Charles", "Christian", "Christine", "Claire", "Daniel", "David", "Diego", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Fernando", "Francisco", "Frank", "François", "Friedrich", "George", "Hans", "Heinrich", "Isabel", "Jacques", "James", "Javier", "Jean", "Jennifer", "Johann", "John", "José", "Joseph", "Juan", "Julia", "Julie", "Jürgen", "Karen", "Karl", "Katharina", "Klaus", "Laura", "Linda", "Lisa", "Louis", "Lucía", "Luis", "Manuel", "Margaret", "María", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Miguel", "Monika", "Nicolas", "Olivier", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Petra", "Philippe", "Pierre", "Rafael", "Richard", "Robert", "Sabine", "Sarah", "Sofía", "Sophie", "Stefan", "Stephen", "Susan", "Teresa", "Thomas", "Ursula", "William", "Wolfgang")
#: Last words of names of places and bodies.
PLACES = ("Avenue", "Boulevard", "Bridge", "Church", "City", "College", "County", "Foundation", "Gasse", "Hall", "Hospital", "House", "Institute", "Island", "Lake", "Lane", "Library", "Museum", "Park", "Platz", "River", "Road", "School", "Square", "Station", "Straße", "Street", "Tower", "University", "Weg")
#: Words before a span that speak for each kind, and words that speak against any.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip ", "ip:", "host", "server", "address", "from "),
    "card": ("card", "visa", "credit", "payment", "paid"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "transfer"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "obfuscated_email": ("mail", "contact", "write"),
    "person": ("name", "mr", "mrs", "dr", "herr", "frau", "dear", "by ", "signed", "i am ", "i'm ", "sincerely", "regards", "contact", "attn", "author", "patient", "ask for", "speak ", "appelle", "nom est", "cher ", "chère ", "signé", "heiße", "liebe", "gezeichnet", "llamo", "nombre", "estimad", "querid", "firmado"),
    "secret": ("token", "secret", "password", "key", "auth"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "release", "section", "chapter", "order", "invoice", "isbn", "tracking", "article", "part no", "model", "serial", "build", "ticket", "street", "new ", "university")
LABELERS = ("shape", "checksum", "gazetteer", "context", "against", "surroundings")
_AGAINST = re.compile("|".join(map(re.escape, AGAINST)))
_CONTEXT = {k: re.compile("|".join(map(re.escape, v))) for k, v in CONTEXT.items()}
_NEAR = re.compile(r"[^\W\d_]+")
_GIVEN = frozenset(GIVEN)
#: Buckets for the two words before a span.
BUCKETS = 16

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; from each @ outwards, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # what lies before this @ can't begin a later match
        at = text.find("@", max(at + 1, done))


def checked(kind: str, value: str) -> bool:
    """Whether a match of a base kind passes its check."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    if kind == "card":
        digits = value.replace(" ", "").replace("-", "")
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= sum(c.isdigit() for c in value) <= 15


def base_matches(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the base kinds, before their checks."""
    out: list[Span] = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        out += [(kind, *m.span()) for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)) for m in pattern.finditer(text)]
    return out


def base_spans(text: str) -> list[Span]:
    """The four base kinds with their checks; a match that fails is dropped and not retried."""
    return [s for s in base_matches(text) if checked(s[0], text[s[1] : s[2]])]


def more_spans(text: str) -> list[Span]:
    """Candidates beside the base spans: matches that failed their check and are long enough to mean something, and further kinds."""
    matches, lowered = base_matches(text), text.lower()  # to see at once which patterns are worth a scan
    out = [s for s in matches if not checked(s[0], text[s[1] : s[2]]) and s[2] - s[1] >= (12 if s[0] == "card" else 7)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(2)) for m in _ASSIGNED.finditer(text)]
        if any(n in lowered for n in _NAMED):
            out += [("secret", *m.span(2)) for m in _BARE.finditer(text)]
    if "at" in text and ("[" in text or "(" in text):
        out += [("obfuscated_email", *m.span()) for m in _OBFUSCATED.finditer(text)]
    if _DIGIT.search(text):
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        out += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    # Two capitals alone are no reason to look: a title or an introduction stands before, or a given name begins.
    named = [m.span() for m in _TITLED.finditer(text)] if any(t in text for t in _TITLES) else []
    if any(p in lowered for p in INTRODUCTIONS):
        named += [m.span(1) for m in _INTRODUCED.finditer(text)]
    named += [m.span() for m in _PERSON.finditer(text) if _HONORIFIC.match(m[0]) or m[0].partition(" ")[0] in _GIVEN]
    last = 0
    for start, end in sorted(set(named), key=lambda s: (s[0], -s[1])):
        if start >= last:  # of overlapping ones the first and longest
            out.append(("person", start, end))
            last = end
    inside = sorted((a, b) for k, a, b in matches if checked(k, text[a:b]))
    starts = [a for a, _ in inside]
    ends = list(np.maximum.accumulate([b for _, b in inside])) if inside else []

    def covered(a: int, b: int) -> bool:
        i = bisect_right(starts, a) - 1
        return i >= 0 and ends[i] >= b

    return sorted({s for s in out if not covered(s[1], s[2])}, key=lambda s: (KINDS.index(s[0]), s[1]))


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return len(v) >= 15 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def votes(kind: str, start: int, end: int, text: str) -> list[int]:
    """Of each labeler: 1 (personal), 0 (not) or -1 (no vote)."""
    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    line = before.rpartition("\n")[2].lower()
    digits = re.sub("[^0-9]", "", value)
    shape, checksum, gazetteer = 1, -1, -1
    if kind == "secret":
        classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        shape = int(len(set(value)) >= 8 and classes >= 2 and len(value) >= 12)
        name = re.search(r"([A-Za-z_-]+)[ \t]*[=:][ \t]*[\"']?$", before)
        gazetteer = int(bool(name) and any(s in name[1].lower() for s in SECRET_NAMES) and not any(p in value.lower() for p in PLACEHOLDERS))
    elif kind == "ssn":
        area, group, serial = value.split("-")
        checksum = int(area not in ("000", "666") and area < "900" and group != "00" and serial != "0000")
    elif kind == "iban":
        checksum, gazetteer = int(iban_valid(value)), int(value[:2] in ACCOUNTS)
    elif kind == "card":
        shape = int(not re.search("[ -]", value) or bool(re.fullmatch(r"[0-9]{4}([ -][0-9]{3,6}){2,4}", value)))
        checksum, gazetteer = int(luhn(digits)), int(len(digits) >= 13 and digits.startswith(CARDS))
    elif kind == "ip":
        shape = int(not re.search(r"(^|\.)0[0-9]", value))
        checksum, gazetteer = int(checked("ip", value)), int(not value.startswith(("0.", "1.", "2.", "127.", "255.")))
    elif kind in ("email", "obfuscated_email"):
        last = re.split(r"[\s.)\]]+", value)[-1].lower()
        gazetteer = int(last not in RESERVED and (last in DOMAINS or len(last) == 2))
        shape = int(".." not in value and not value.startswith("."))
    elif kind == "phone":
        shape = int(value.count("(") == value.count(")") <= 1)
        checksum, gazetteer = int(8 <= len(digits) <= 15), int(digits.startswith(CALLING))
    elif kind == "local_phone":
        gazetteer = int(digits[0] >= "2" and digits[3] >= "2")
    elif kind == "person":
        # A name that no list holds says nothing either way.
        gazetteer = 1 if _HONORIFIC.sub("", value).partition(" ")[0] in _GIVEN else -1
        shape = 1 if _HONORIFIC.match(value) else 0 if value.split(" ")[-1] in PLACES else -1
    context = 1 if _CONTEXT[kind].search(line) else -1
    against = 0 if _AGAINST.search(line[-25:]) else -1
    glued = bool(re.search(r"[A-Za-z0-9]$|[0-9][.-]$", before)) or bool(re.match(r"[A-Za-z0-9]|[.-][0-9]", after))
    return [shape, checksum, gazetteer, context, against, 0 if glued else -1]


def look(kind: str, start: int, end: int, text: str) -> list[int]:
    """Places of the features of a span and its context that hold, beside the votes."""
    value = text[start:end]
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    variety = len(set(value)) / n
    out = [min(3, n // 8), 4 + min(2, 3 * digits // n), 7 + min(2, int(3 * variety))]
    previous, following = text[start - 1 : start], text[end : end + 1]
    out += [10 + (0 if not previous else 1 if previous.isspace() else 2), 13 + (0 if not following else 1 if following.isspace() else 2)]
    words = _NEAR.findall(text[max(0, start - 30) : start].lower())[-2:]
    return out + sorted({16 + zlib.crc32(w.encode()) % BUCKETS for w in words})


@dataclass(frozen=True)
class SpanModel:
    """Logistic weights by feature; by kind, per labeler how often it is right on personal spans and on others."""

    weights: tuple[float, ...]
    accuracy: tuple[tuple[str, tuple[tuple[float, float], ...]], ...]

    def probability(self, kind: str, vote: list[int], seen: list[int]) -> float:
        z = float(np.dot(self.weights, span_features(kind, vote, seen)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def accepts(self, kind: str, vote: list[int], seen: list[int], least: float) -> bool:
        """Whether the span is personal; one whose checksum fails also needs words before it that speak for it."""
        if vote[LABELERS.index("checksum")] == 0 and vote[LABELERS.index("context")] != 1:
            return False
        return self.probability(kind, vote, seen) >= least


def span_features(kind: str, vote: list[int], seen: list[int]) -> np.ndarray:
    near = np.zeros(16 + BUCKETS)
    near[seen] = 1
    of_kind = np.array([k == kind for k in KINDS], float)
    cast = np.concatenate([[v == 1 for v in vote], [v == 0 for v in vote]]).astype(float)
    return np.concatenate([np.outer(of_kind, cast).ravel(), of_kind, near, [1.0]])


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[list[tuple[float, float]], list[float]]:
    """For the spans of one kind: labelers' reliabilities and each pattern's posterior, labelers taken as independent given the truth.

    Priors (as many seen votes as they sum to) hold a labeler better than chance.
    """
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    yes_vote, no_vote = (v == 1).astype(float), (v == 0).astype(float)
    cast = yes_vote + no_vote
    # To begin with, the majority of the votes cast is taken for the truth; labelers that vote alike on every span only count where no other votes.
    telling = (v != v[0]).any(axis=0)
    told = cast[:, telling].sum(axis=1) > 0
    ayes = np.where(told, yes_vote[:, telling].sum(axis=1), yes_vote.sum(axis=1))
    all_ = np.where(told, cast[:, telling].sum(axis=1), cast.sum(axis=1))
    post = np.clip((ayes + 0.5) / (all_ + 1), 0.05, 0.95)
    right = np.zeros((v.shape[1], 2))
    for _ in range(rounds):
        share = np.clip((n @ post + 2) / (n.sum() + 4), 0.02, 0.98)
        right[:, 0] = (yes_vote.T @ (n * post) + 8) / (cast.T @ (n * post) + 10)
        right[:, 1] = (no_vote.T @ (n * (1 - post)) + 8) / (cast.T @ (n * (1 - post)) + 10)
        right = np.clip(right, 0.02, 0.98)
        yes = np.log(share) + yes_vote @ np.log(right[:, 0]) + no_vote @ np.log(1 - right[:, 0])
        no = np.log(1 - share) + no_vote @ np.log(right[:, 1]) + yes_vote @ np.log(1 - right[:, 1])
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return [tuple(map(float, r)) for r in right], [float(p) for p in post]


def train(rows: list[tuple[str, list[int], list[int], int]], steps: int = 60, ridge: float = 1.0) -> SpanModel:
    """EM over the counts of vote patterns; then a classifier fitted to its posteriors.

    rows: kind, votes, features of one span, and how many spans it stands for.
    """
    if not rows:
        return SpanModel((0.0,) * len(span_features(KINDS[0], [-1] * len(LABELERS), [])), ())
    counts: dict[str, dict[tuple, int]] = {}
    for kind, vote, _, n in rows:
        of = counts.setdefault(kind, {})
        of[tuple(vote)] = of.get(tuple(vote), 0) + n
    accuracy, told = [], {}
    for kind, of in counts.items():
        right, post = em(list(of.items()))
        accuracy.append((kind, tuple(right)))
        told |= {(kind, v): p for v, p in zip(of, post, strict=True)}
    x = np.array([span_features(k, v, seen) for k, v, seen, _ in rows])
    y, n = np.array([told[k, tuple(v)] for k, v, *_ in rows]), np.array([c for *_, c in rows], float)
    w, n = np.zeros(x.shape[1]), n * min(1.0, 10_000 / n.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return SpanModel(tuple(map(float, w)), tuple(accuracy))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, and all spans with their votes and features; base spans that pass their checks have ``base``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for text in pdf["text"]:
                text = text or ""
                spans = [(*s, True) for s in sorted(base_spans(text), key=lambda s: (KINDS.index(s[0]), s[1]))] + [(*s, False) for s in more_spans(text)]
                found.append([{"kind": k, "start": a, "end": b, "base": base, "votes": votes(k, a, b, text), "seen": look(k, a, b, text)} for k, a, b, base in spans])
            yield pd.DataFrame({"id": pdf["id"], "found": found})

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInPandas(run, f"id {kind}, found array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,seen:array<int>>>")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit(found: DataFrame, slots: int = 8) -> SpanModel:
    """The model of all candidates.

    Every candidate is counted; of each kind, vote pattern and slot of hashed
    features the first in order stands for the slot's count, so that the driver
    gets at most kinds x 3 ** labelers x ``slots`` rows.
    """
    seen = found.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.seen")
    slot = F.pmod(F.xxhash64("seen"), F.lit(slots))
    rows = seen.groupBy("kind", "votes", slot.alias("slot")).agg(F.min("seen").alias("seen"), F.count("*").alias("n"))
    return train([(r["kind"], list(r["votes"]), list(r["seen"]), r["n"]) for r in rows.orderBy("kind", "votes", "slot").collect()])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> tuple[DataFrame, SpanModel]:
    """Per row: id, counts of the base kinds, base_sha256, spans, n_more; and the model behind."""
    found = cut(candidates(docs, id_col, text_col))
    model = fit(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for spans in pdf["found"]:
                base = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
                more = [(s["kind"], s["start"], s["end"]) for s in spans if not s["base"] and model.accepts(s["kind"], list(s["votes"]), list(s["seen"]), least)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                spans_ = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append((*(sum(k == b for k, *_ in base) for b in BASE), digest, joined(spans_), len(more)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more"])
            out.insert(0, id_col, pdf["id"].to_numpy())
            yield out

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInPandas(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long"), model


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; the model is trained on all rows."""
    model = fit(cut(candidates(docs.withColumn("__row", F.lit(0)), "__row", text_col)))

    def clean(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text:
                return text
            spans = [*base_spans(text), *(s for s in more_spans(text) if model.accepts(s[0], votes(*s, text), look(*s, text), least))]
            return redact(text, spans) if spans else text

        return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))
