"""Typed company names: parts, their meaning, and how well two names fit."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

# Word lists of English company names.
LEGAL = {
    "inc": "inc incorporated", "corp": "corp corporation", "co": "co company cmpny", "ltd": "ltd limited", "plc": "plc", "nv": "nv",
    "holdings": "holdings holding hldg hldgs", "group": "group grp",
}
PRIVATE = frozenset("gmbh llc llp lp ulc dac bv pte ag sa sarl srl spa kg oy ab".split())
RELATIONS = tuple("sons daughters brothers associates partners sisters".split())
RELATION_SHORT = {"bros": "brothers", "assoc": "associates", "assocs": "associates", "ptnrs": "partners", "dtrs": "daughters"}
SECTORS = tuple(
    "aerospace automotive bancorp biosciences chemicals communications diagnostics energy entertainment financial foods industries "
    "insurance international logistics manufacturing materials medical mining networks petroleum pharmaceuticals properties realty "
    "resources robotics semiconductor software technologies therapeutics".split())
SECTOR_SHORT = {"dx": "diagnostics", "rx": "pharmaceuticals", "tx": "therapeutics", "intl": "international", "mfg": "manufacturing"}
PLACES = frozenset("deutschland netherlands ireland canada singapore delaware ontario finance sub ii iii iv of".split())
FUNDS = frozenset("fund funds etf trust index portfolio".split())
HEDGES = frozenset(
    "the probably likely maybe perhaps possibly presumably guess guessing believe think parent common stock ordinary shares i a an or "
    "not sure unclear its".split())
NOTHING = frozenset(("", "unknown", "n a", "na", "tbd", "various", "multiple issuers", "see notes", "none given", "none", "null", "nan", "nil", "not known", "no idea", "unclear", "many", "several"))
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sandy al", "benjamin": "ben benny", "charles": "charlie chuck chas", "christopher": "chris kit",
    "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted", "elizabeth": "liz beth betty eliza lizzie bess", "frederick": "fred freddy fritz",
    "henry": "hank harry hal", "josephine": "jo josie", "katherine": "kate kathy katie kit", "lawrence": "larry", "margaret": "peggy maggie meg",
    "nathaniel": "nate nat", "richard": "dick rick rich", "robert": "bob rob bobby", "susannah": "sue susan susie", "theodore": "ted theo teddy",
    "william": "bill will billy", "james": "jim jimmy", "john": "jack johnny", "thomas": "tom tommy", "michael": "mike", "daniel": "dan danny",
    "samuel": "sam sammy", "joseph": "joe joey", "anthony": "tony", "patricia": "pat patty", "rebecca": "becky", "andrew": "andy drew",
}

_LEGAL_OF = {v: k for k, many in LEGAL.items() for v in many.split()}
_FORMAL = defaultdict(set)
for _name, _short in NICKNAMES.items():
    for _s in (_name, *_short.split()):
        _FORMAL[_s].add(_name)
_STATE = re.compile(r"\s*/\s*[A-Za-z]{2}\s*/?\s*$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[a-z]{3})(?=[A-Z]{2,}$)")
_BRACKET = re.compile(r"[(\[]([^)\]]*)[)\]]")


def plain(text: str) -> str:
    """ASCII letters of a text: accents dropped, invisible characters removed."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if c.isascii())


def split_words(text: str) -> list[str]:
    """Lower-case words; ``&``, ``+`` and ``/`` become ``and``; spelled-out legal forms (N. V.) are put together."""
    text = _CAMEL.sub(" ", _STATE.sub("", plain(text))).lower()
    text = re.sub(r"['’`]", "", text)
    found = re.findall(r"[a-z0-9]+", re.sub(r"[&+/]", " and ", text))
    out: list[str] = []
    for word in found:
        if len(word) == 1 and out and len(out[-1]) <= 2 and (out[-1] + word) in {"nv", "lp", "bv", "pl", "plc", "sa", "ag", "ll", "llc", "llp"}:
            out[-1] += word
        else:
            out.append(word)
    return out


@lru_cache(200_000)
def damerau(a: str, b: str) -> float:
    """Weighted edit distance with transpositions: slips of the hand cost less than other changes."""
    if a == b:
        return 0.0
    digits, vowels = {"0": "o", "1": "li", "3": "e", "5": "s", "8": "b", "4": "a", "7": "t"}, "aeiou"
    before, last = [], [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            if x == y:
                best = last[j - 1]
            else:
                swap = 0.5 if y in digits.get(x, "") or x in digits.get(y, "") else 0.8 if x in vowels and y in vowels else 1.0
                best = min(last[j - 1] + swap, last[j] + (0.7 if i > 1 and a[i - 2] == x else 1.0), row[-1] + (0.7 if j > 1 and b[j - 2] == y else 1.0))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 0.7)
            row.append(best)
        before, last = last, row
    return last[-1]


@lru_cache(200_000)
def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of the lengths, by bit-parallel rows."""
    if a == b:
        return 1.0
    place: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        place[c] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / max(1, len(a) + len(b))


def damerau_likeness(a: str, b: str) -> float:
    """1 for equal words, falling with the weighted distance; 0 beyond the bound for their length."""
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    bound = 0.0 if size < 4 else 1.0 if size < 8 else 2.0
    if abs(len(a) - len(b)) > bound or not bound:
        return 0.0
    d = damerau(a, b)
    return 1 - d / size if d <= bound else 0.0


def lcs_likeness(a: str, b: str) -> float:
    """The subsequence ratio where it is at least four fifths, else 0."""
    if a == b:
        return 1.0
    ratio = lcs_ratio(a, b) if min(len(a), len(b)) > 3 else 0.0
    return ratio if ratio >= 0.8 else 0.0


@lru_cache(200_000)
def letter_set(word: str) -> int:
    """The distinct letters and digits of a word as bits."""
    return sum(1 << (ord(c) - (48 if c <= "9" else 87)) for c in set(word))


def _within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


class _Listed:
    """Listed words of one kind, found by what a typed word shows of them."""

    def __init__(self, options: Iterable[str], short: dict[str, str]) -> None:
        self.options, self.short = tuple(options), short
        self.places = {o: i for i, o in enumerate(self.options)}
        self.heads: dict[str, int] = {}
        for i, o in enumerate(self.options):
            for n in range(3, len(o) + 1):
                self.heads.setdefault(o[:n], i)
        self.by_length = sorted(self.options, key=len)
        # Options of nearly the same length, with the sets of their letters.
        self.near: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for o in self.options:
            if len(o) > 4:
                for n in range(len(o) - 2, len(o) + 3):
                    self.near[n].append((o, letter_set(o)))

    def begun(self, word: str) -> str | None:
        """The first option that the word, or the word without a last s, begins."""
        found = [self.heads.get(word, -1)] if len(word) >= 3 else []
        if len(word) >= 4 and word[-1] == "s":
            found.append(self.heads.get(word[:-1], -1))
        places = [i for i in found if i >= 0]
        return self.options[min(places)] if places else None

    def skeleton(self, word: str) -> str | None:
        """The shortest option whose letters the word takes in order, without vowels after the second."""
        if len(word) < 3 or not _VOWELS.isdisjoint(word[2:]):
            return None
        return next((o for o in self.by_length if len(word) <= len(o) - 2 and word[0] == o[0] and _within(word, o)), None)

    def mistyped(self, word: str) -> str | None:
        """The option that lies nearest by the weighted distance, within the bound for the length."""
        mine, n, best = letter_set(word), len(word), (9.0, "")
        for o, theirs in self.near.get(n, ()):
            # No common subsequence has a letter that one of the words lacks.
            most = min(n - (mine & ~theirs).bit_count(), len(o) - (theirs & ~mine).bit_count())
            if 20 * most > 7 * (n + len(o)) and lcs_ratio(word, o) > 0.7:
                best = min(best, (damerau(word, o), o))
        return best[1] if n > 3 and best[0] <= (1.0 if n < 8 else 2.0) else None


_VOWELS = frozenset("aeiou")
_LISTED = {"sector": _Listed(SECTORS, SECTOR_SHORT), "relation": _Listed(RELATIONS, RELATION_SHORT), "legal": _Listed(_LEGAL_OF, {})}


@lru_cache(50_000)
def _known(word: str, kind: str) -> str | None:
    """The listed word that ``word`` is, or is short or mistyped for."""
    listed = _LISTED[kind]
    if word in listed.places:
        return word
    if word in listed.short:
        return listed.short[word]
    found = None if kind == "legal" else listed.begun(word) or listed.skeleton(word)
    return found or listed.mistyped(word)


@lru_cache(50_000)
def _first_name(word: str) -> str | None:
    """The listed first name that a word of six or more letters is mistyped for."""
    if len(word) < 6:
        return None
    # Within a distance of 1 at most two slips of the hand change at most four letters of the sets.
    return next((n for n in NICKNAMES if abs(len(n) - len(word)) < 2 and (letter_set(n) ^ letter_set(word)).bit_count() < 5 and damerau(n, word) <= 1), None)


@dataclass
class Name:
    """Parts of a name by meaning, in order of appearance."""

    stems: list[str] = field(default_factory=list)
    firsts: list[str] = field(default_factory=list)
    initials: list[str] = field(default_factory=list)
    sectors: list[str] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    legal: list[str] = field(default_factory=list)
    private: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    funds: bool = False
    joined: bool = False
    tickers: list[str] = field(default_factory=list)

    @property
    def person(self) -> bool:
        """A first name and one more word and nothing that makes a company of them."""
        return bool(self.firsts) and len(self.stems) == 1 and not (self.sectors or self.relations or self.legal or self.joined)


def parse(words: Iterable[str], stems: frozenset[str] | set[str] = frozenset(), exact: bool = False) -> Name:
    """Sort the words of a name by meaning; ``stems`` are words known to be a company's own.

    ``exact`` is for registered names: no word is short or mistyped for another.
    """
    out = Name()
    for word in words:
        if word == "and":
            out.joined = True
        elif word in stems:
            out.stems.append(word)
        elif word in _LEGAL_OF:
            out.legal.append(_LEGAL_OF[word])
        elif word in PRIVATE:
            out.private.append(word)
        elif word in FUNDS:
            out.funds = True
        elif word in HEDGES:
            continue
        elif word in PLACES:
            out.places.append(word)
        elif word in _FORMAL:
            out.firsts.append(word)
        elif len(word) == 1:
            out.initials.append(word)
        elif exact:
            (out.relations if word in RELATIONS else out.sectors if word in SECTORS else out.stems).append(word)
        elif (found := _known(word, "relation")) and found not in out.relations:
            out.relations.append(found)
        elif found := _known(word, "legal"):
            out.legal.append(_LEGAL_OF[found])
        elif found := _known(word, "sector"):
            out.sectors.append(found)
        elif found := _first_name(word):
            out.firsts.append(found)
        else:
            out.stems.append(word)
    return out


_ENDS = frozenset({*SECTORS, *RELATIONS, *_LEGAL_OF, *SECTOR_SHORT, *RELATION_SHORT, "and", *_FORMAL})
_SHORTS = frozenset(s[:k] for s in SECTORS for k in range(3, len(s)))
_SIZES = tuple((parts, sorted({len(p) for p in parts if len(p) > 1}, reverse=True)) for parts in (_ENDS, _SHORTS))


def unglued(words: list[str], stems: frozenset[str] | set[str]) -> list[str]:
    """Words written together taken apart: the longest known word at either end of a long word is split off."""

    def cut(word: str, depth: int) -> list[str]:
        if word in stems or word in _ENDS or len(word) < 7 or depth > 5:
            return [word]
        middle = next((m.start() for m in re.finditer("and", word) if word[:m.start()] in stems and word[m.end():] in stems), None) if stems else None
        if middle is not None:
            return [word[:middle], "and", word[middle + 3:]]
        for parts, sizes in _SIZES if depth < 3 else _SIZES[:1]:
            for size in sizes:
                if len(word) - size < 4:
                    continue
                head, tail = word[:size], word[-size:]
                first = head in parts and (size > 4 or word[size:] in stems)
                if tail in parts and not (first and head < tail):
                    return [*cut(word[:-size], depth + 1), tail]
                if first:
                    return [head, *cut(word[size:], depth + 1)]
        return [word]

    return [piece for word in words for piece in cut(word, 0)]


def acronyms(words: list[str]) -> set[str]:
    """First letters of all words, also without the last if that is a legal form."""
    letters = "".join(w[0] for w in words if w != "and")
    return {a for a in (letters, letters[:-1] if words and words[-1] in _LEGAL_OF else letters) if len(a) > 2}


def spelled(words: list[str]) -> str:
    """The one code that a typed name consists of (``KABA``, ``K.A.B.A.``, ``KABA US``), else empty."""
    if len(words) == 1 or (len(words) == 2 and words[1] in {"us", "un", "ln", "equity"}):
        return words[0]
    return "".join(words) if 2 < len(words) < 7 and sum(map(len, words)) <= len(words) + 1 else ""


def first_fits(query: Name, company: Name) -> float | None:
    """0 without evidence, positive for the same first name, None for another one."""
    if not company.firsts:
        return -0.3 if query.firsts else 0.0
    wanted = set().union(*(_FORMAL.get(f, {f}) for f in company.firsts))
    if query.firsts:
        given = set().union(*(_FORMAL.get(f, {f}) for f in query.firsts))
        return 0.3 if wanted & given else None
    if query.initials:
        return 0.2 if {i for i in query.initials} & {w[0] for w in wanted} else None
    return 0.0


def fit(query: Name, company: Name, likeness: Callable[[str, str], float]) -> float | None:
    """How well a typed name fits a company; None if a part of it speaks against.

    Every own word of the query must be found in the company; missing words
    cost more than missing sectors, and legal forms only settle ties.
    """
    own, theirs = list(query.stems), list(company.stems)
    if not own or not theirs:
        return None
    score, slips = 0.0, 0.0
    if len(own) == 1 and len(theirs) > 1 and (both := likeness(own[0], "".join(theirs))):
        score, slips, left = 2 * both, 1 - both, []
        own = []
    else:
        left = []
        for word in own:
            best = max(((likeness(word, t), t) for t in theirs), default=(0.0, ""))
            if not best[0]:
                return None
            theirs.remove(best[1])
            score += best[0]
            slips += 1 - best[0]
        left = theirs
    score -= 0.6 * len(left)
    if query.sectors:
        if not company.sectors or not set(query.sectors) & set(company.sectors):
            return None
        score += 0.5
    if query.relations:
        if not set(query.relations) & set(company.relations):
            return None
        score += 0.5
    elif query.joined and not (len(company.stems) > 1 and company.joined) and not company.relations:
        return None
    first = first_fits(query, company)
    if first is None:
        return None
    score += first
    if slips and not (query.sectors or query.relations or query.legal or len(query.stems) > 1) and slips > 0.17:
        return None
    if query.legal:
        same = len(set(query.legal) & set(company.legal))
        score += 0.05 * same - 0.04 * len(set(query.legal) - set(company.legal))
    return score


def acceptable(name: Name) -> bool:
    """False for persons, funds and private firms that no listed company stands behind."""
    if name.funds or name.person or (not name.stems):
        return False
    return not name.private or bool(name.places)
