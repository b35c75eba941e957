"""Defective prompt and response pairs: a multi-label linear classifier on hashed n-grams and pair features."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("empty", "copy", "refusal", "language", "truncated")
WEIGHT_BITS, COUNT_BITS = 17, 18

# Strings that say nothing, and function words of languages written in Latin letters.
PLACEHOLDERS = frozenset("null none nan nil n/a na tbd todo tba unknown pending nothing - -- --- ? ?? ??? . .. ... {} [] () \"\" '' placeholder xxx".split()) | {"no answer", "no response", "no reply", "left blank", "blank", "not available", "not applicable", "empty", "no text"}
ENGLISH = frozenset(
    "the of and to in a is that it for was on are with as by at be this from or an which not have has had but its their were would will "
    "after before when who what if because near only than twice should could into about there where".split())
_HANGING = frozenset("the a an of to in on for with as by at from and or but its their his her is are was were be been because although while since if that than which who whose into beside near due".split())
_HANGING_WORDS = tuple(sorted(_HANGING))
FOREIGN = {
    "de": "der die das und den dem ein eine einer nicht mit sich auf für von ist wird werden bei nach wegen durch keine oder zum zur im",
    "fr": "le la les des du un une dans est et pour sur avec par aux cette ce qui que pas ses sont après sans leur au",
    "es": "el los las una del que por con para está son sus pero más como sobre tras sin este esta en y se su",
    "pt": "os as uma do da dos das que para com não por seu sua está mais como após sem pelo pela na no em e",
    "it": "il lo gli una del della dei delle che per con non sono dopo senza nella dal alla è di e si",
    "nl": "het een van en voor met niet zijn door naar bij ook uit wordt werd geen dit deze op te",
    "sv": "och att som på är för av med den det inte till från om har efter utan sig under grund",
    "da": "og at som på er af med den det ikke til fra om har efter uden sig under blev ved",
    "pl": "i w na z że się nie do po przez jest oraz dla przy bez od są został",
    "fi": "ja on ei että se oli kun mutta sekä ovat jälkeen ilman vuoden yhtiön",
    "tr": "ve bir bu için ile olarak de da çok daha sonra ama gibi olan",
}
_FOREIGN = frozenset(w for text in FOREIGN.values() for w in text.split()) - ENGLISH - {"no", "i", "die", "van", "per", "om", "at", "under", "plus", "pro", "max"}
# Parts of refusals, put together at random for training.
_OPEN = ("I'm sorry, but", "Sorry,", "Unfortunately", "I apologize, but", "As an AI language model,", "As an AI assistant,", "I regret that", "With regret,", "Thank you for asking, but", "", "")
_CORE = ("I cannot", "I can't", "I am unable to", "I'm not able to", "I am not able to", "I am not allowed to", "I won't", "I must decline to",
         "I have to decline to", "it is not possible for me to", "it would be inappropriate for me to", "my guidelines do not allow me to",
         "I'd rather not", "I don't feel comfortable trying to", "I am not permitted to", "I will not", "I do not", "we do not", "I am going to avoid attempts to")
_ACT = ("answer this question", "help with that", "provide forecasts for individual securities", "give financial advice", "identify the company behind this filing",
        "guess who filed it", "share opinions on stocks", "respond to this request", "assist with this request", "comment on this", "discuss this topic",
        "respond", "answer", "make predictions", "do that", "speculate", "identify anonymous filers", "offer investment advice", "provide this information")
_WHOLE = ("this request goes beyond what I'm permitted to do.", "no answer can be given here, since financial advice is outside my remit.", "that is outside what I can do.",
          "this is not something I can help with.", "my policies keep me from answering this.", "my guidelines prevent me from making such a guess.", "I have to pass on this one.",
          "answering this would go against my guidelines.", "this falls outside what I may discuss.", "requests like this are ones I decline.", "let's talk about something else.", "this topic is off limits for me.",
          "that is not something I do.", "I will pass on this item.")
_WHY = ("", "", "because the content may be sensitive", "as this could be seen as financial advice", "since that goes against my guidelines", "without more information", "for policy reasons")
_SCRIPTS = ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0xAC00, 0xD7A3), (0x0430, 0x044F), (0x0627, 0x064A), (0x03B1, 0x03C9), (0x0905, 0x0939))
_TAIL = ("", "", "Please consult a professional.", "Please consult a licensed adviser.", "You could look at other sources instead.", "Is there something else I can help with?", "Let me know if I may assist with anything else.")

_TOKEN = re.compile(r"\w+(?:['’]\w+)?|[^\w\s]")
_UNSAID = re.compile(r"(?:no|not|without) (?:an? )?(?:answer|response|reply|text|data|value|output)(?: (?:given|provided|available|found|supplied|recorded|yet))?|(?:answer|response|reply|clue|rationale|reason|recalled|output|a) ?:?")
_QUOTED = re.compile(r"[“\"«][^”\"»]{0,400}[”\"»]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def tidy(text: str | None) -> str:
    return " ".join(_INVISIBLE.sub("", text).split()) if text else ""


def word_buckets(text: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) & ((1 << COUNT_BITS) - 1) for w in set(_TOKEN.findall(tidy(text).lower()))]


def _level(x: np.ndarray, steps: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(steps, float), x, "left")


_STRIPPED, _CLOSING = frozenset(".!?”\"'"), frozenset(".!?”\"')")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of several columns of numbers."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ np.asarray(part).astype(np.uint64)) * _ODD
            out = (out ^ (out >> np.uint64(29))) * _MIX
    return out


class _Words:
    """Numbers for the words of a batch, and what is known of each word, found once a word."""

    def __init__(self) -> None:
        self.ids: defaultdict[str, int] = defaultdict(count().__next__)

    def put(self, words: list[str], into: list[int]) -> int:
        into.extend(map(self.ids.__getitem__, words))
        return len(words)

    def known(self, counts: np.ndarray, total: int) -> dict[str, np.ndarray]:
        words = list(self.ids) + [""]  # the last row stands for no word
        test = lambda f: np.array([bool(f(w)) for w in words])
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        often = counts[(hashes & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)]
        shown = np.where(test(lambda w: w[:1].isdigit()), np.uint64(1), np.where((often * 100 >= total) | test(ENGLISH.__contains__), hashes | np.uint64(4), np.uint64(2)))
        shown[-1] = 0
        usual = shown != 2  # a rare mark closes nothing
        return {"shown": shown, "often": often, "alnum": test(lambda w: w[:1].isalnum()), "said": test(lambda w: w[:1].isalnum() or w[:1] == "_"), "alpha": test(lambda w: w[:1].isalpha()),
                "english": test(ENGLISH.__contains__), "foreign": test(_FOREIGN.__contains__), "marked": test(lambda w: not w.isascii()), "hangs": test(_HANGING.__contains__),
                "stripped": test(_STRIPPED.__contains__) & usual, "closing": test(_CLOSING.__contains__) & usual}


def _nothing(low: str) -> bool:
    bare = low.strip(" .!\"'()[]{}<>*_")
    return not any(c.isalnum() for c in low) or bool(_UNSAID.fullmatch(bare)) or not PLACEHOLDERS.isdisjoint((low, bare, bare.replace(".", "")))


def encoded(pairs: list[tuple[str | None, str | None, str]], counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of (question, answer, probe) pairs: (features of all rows one after another, where each row starts and the end).

    ``counts`` are document frequencies of words by hash over all answers of
    the input; words in fewer than one answer of a hundred are masked, so that
    n-grams speak of sentence patterns and not of names.
    """
    words, n = _Words(), len(pairs)
    said, asked, outside = [], [], []
    sizes, asked_sizes, outside_sizes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    void, tail, opened, alien, quoted = (np.zeros(n, np.int64) for _ in range(5))
    for i, (question, answer, kind) in enumerate(pairs):
        low = tidy(answer).lower()
        if len(low) < 80:
            if kind == "recall" and low.strip(" .!\"'()[]{}<>*_") in ("nothing", "none"):
                void[i] = 2
            elif _nothing(low):
                void[i] = 1
        sizes[i] = words.put(_TOKEN.findall(low), said)
        asked_sizes[i] = words.put(_TOKEN.findall(tidy(question).lower()), asked)
        tail[i] = 9 if low.endswith(("...", "…")) else 1 + "-,;:(".find(low[-1:]) if low else 0
        opened[i] = 2 * (low.count("“") > low.count("”")) + (low.count("(") > low.count(")")) if "(" in low or "“" in low else 0
        if "“" in low or '"' in low or "«" in low:
            quoted[i] = 1
            outside_sizes[i] = words.put(_TOKEN.findall(_QUOTED.sub(" ", low)), outside)
        if not low.isascii():
            signs = [c for c in low if c.isalpha()]
            share = sum(ord(c) > 0x24F and "LATIN" not in unicodedata.name(c, "LATIN") for c in signs) / max(1, len(signs))
            alien[i] = (share > 0) + (share > 0.3)
    known = words.known(counts, total)
    none = len(known["shown"]) - 1
    rows = np.arange(n)
    flat, ask, out = (np.array(x, np.int64) for x in (said, asked, outside))
    row, ask_row, out_row = (np.repeat(rows, z) for z in (sizes, asked_sizes, outside_sizes))
    tally = lambda at, mask: np.bincount(at[mask], minlength=n)[:n]

    found: list[tuple[np.ndarray, np.ndarray]] = []

    def put(kind: int, *values: np.ndarray, at: np.ndarray = rows) -> None:
        use = void[at] == 0 if kind > 3 or kind == 1 else slice(None)  # what stands for nothing has no other feature
        found.append((at[use], _mixed(kind, *values)[use]))

    long = tally(row, known["said"][flat])
    put(1, _level(long, (0, 1, 2, 4, 8, 16, 32)))
    put(2, np.zeros(n))
    put(3, void[void > 0], at=rows[void > 0])
    # Words of the question that come back, each as often as it was asked.
    keys = lambda at, what, mask: np.unique(at[mask] * (none + 1) + what[mask], return_counts=True)
    (mine, times), (theirs, wanted) = keys(row, flat, known["said"][flat]), keys(ask_row, ask, known["alnum"][ask])
    at = np.minimum(np.searchsorted(theirs, mine), max(0, len(theirs) - 1))
    back = np.where(theirs[at] == mine, np.minimum(times, wanted[at]), 0) if len(theirs) else np.zeros(len(mine), np.int64)
    returned = np.bincount(mine // (none + 1), weights=back, minlength=n)[:n].astype(np.int64)
    fresh = np.minimum(long - returned, 6)
    share = returned / np.maximum(1, tally(ask_row, known["alnum"][ask]))
    put(4, fresh)
    put(5, _level(share, (.2, .4, .6, .8, .95)))
    put(6, fresh, _level(share, (.4, .8, .95)))
    shown = known["shown"][flat]
    put(7, shown[shown != 2], at=row[shown != 2])
    for k in (1, 2):
        whole = row[k:] == row[:len(row) - k]
        put(7 + k, *[shown[j:len(shown) - k + j][whole] for j in range(k + 1)], at=row[k:][whole])
    # The end of the answer, with and without its last marks.
    starts = np.cumsum(np.append(0, sizes))[:-1]
    padded = np.append(flat, none)
    word = lambda end, back: np.where(end - back >= starts, padded[np.maximum(end - back, -1)], none)
    end = starts + sizes - 1
    last = word(end, 0)
    closed = known["closing"][last].astype(np.int64)
    bare = end.copy()
    while (strip := known["stripped"][word(bare, 0)]).any():
        bare = bare - strip
    hangs = known["hangs"][word(bare, 0)].astype(np.int64)
    put(10, closed)
    put(11, hangs)
    put(12, hangs, closed)
    for k in range(1, 5):
        put(12 + k, *[known["shown"][word(end, j)] for j in range(k)])
        put(16 + k, closed, *[known["shown"][word(bare, j)] for j in range(k)])
    rare = np.where(known["alpha"][last], _level(known["often"][last], (1, 3, 8, 20)), 9)
    put(21, rare)
    put(22, rare, closed)
    put(23, tail)
    put(24, opened)
    # Language, outside of quotations.
    use = np.where(quoted[row] == 0)[0]
    plain, plain_row = np.concatenate([flat[use], out]), np.concatenate([row[use], out_row])
    alpha = known["alpha"][plain]
    foreign, english, marked = (tally(plain_row, known[x][plain] & alpha) for x in ("foreign", "english", "marked"))
    more = (foreign > english).astype(np.int64)
    put(25, np.minimum(foreign, 6))
    put(26, np.minimum(english, 6))
    put(27, np.minimum(foreign, 4), np.minimum(english, 4))
    put(28, more, _level(foreign - english, (0, 1, 3, 5)))
    put(29, np.minimum(marked, 4), more)
    put(30, alien)
    at, what = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return (what[order] >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64), np.searchsorted(at[order], np.arange(n + 1))


_BIAS, _VOID, _NAUGHT = (int(_mixed(kind, np.array([value]))[0] >> np.uint64(64 - WEIGHT_BITS)) for kind, value in ((2, 0), (3, 1), (3, 2)))


@dataclass
class Model:
    """Weights, the calibration line of each label, and the probability from which on it holds."""

    weights: np.ndarray
    line: np.ndarray
    thresholds: np.ndarray
    counts: np.ndarray
    total: int

    def probabilities(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _probability(_forward(self.weights, flat, starts), self.line)

    def label(self, pairs: list[tuple[str | None, str | None, str]]) -> list[str | None]:
        """The first label, in the order of ``LABELS``, whose probability reaches its threshold; None if none does.

        An answer in another language or a refusal may break off too: what it is goes before how it ends.
        """
        if not pairs:
            return []
        over = self.probabilities(*encoded(pairs, self.counts, self.total)) >= self.thresholds
        return [LABELS[int(o.argmax())] if o.any() else None for o in over]


def _forward(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], starts[:-1], axis=0) if len(starts) > 1 else np.zeros((0, len(LABELS)))


def _probability(z: np.ndarray, line: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z * line[0] + line[1], -40, 40)))


def _taken(flat: np.ndarray, starts: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``take`` of encoded pairs."""
    sizes = starts[take + 1] - starts[take]
    new = np.cumsum(np.append(0, sizes))
    return flat[np.repeat(starts[take] - new[:-1], sizes) + np.arange(new[-1])], new


def fit_linear(flat: np.ndarray, starts: np.ndarray, target: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """One-against-rest logistic weights by Adagrad over small batches; what nothing means is known beforehand."""
    rng = np.random.default_rng(seed)
    weights = untaught()
    spread = np.full_like(weights, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(starts) - 1)
        for at in range(0, len(order), 256):
            take = order[at:at + 256]
            some, first = _taken(flat, starts, take)
            z = np.clip(_forward(weights, some, first), -30, 30)
            slope = np.repeat((1 / (1 + np.exp(-z)) - target[take]) / 256, np.diff(first), axis=0)
            used, place = np.unique(some, return_inverse=True)
            grad = np.stack([np.bincount(place, weights=slope[:, c], minlength=len(used)) for c in range(len(LABELS))], axis=1)
            spread[used] += grad**2
            weights[used] -= 0.15 * grad / np.sqrt(spread[used])
    return weights


def untaught() -> np.ndarray:
    """Weights before any pair is seen: an answer that says nothing is empty, others, and nothing recalled, have no defect."""
    weights = np.zeros((1 << WEIGHT_BITS, len(LABELS)))
    weights[_BIAS] = -4.0
    weights[_VOID, LABELS.index("empty")], weights[_NAUGHT] = 8.0, -4.0
    return weights


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and level of the logistic line that turns scores of held-out pairs into probabilities, by damped Newton steps."""
    if not y.any() or y.all():
        return 1.0, 0.0
    # Counts of both kinds keep the targets off nought and one.
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        slope = x.T @ (p - t)
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        move *= min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def synthetic(pairs: list[tuple[str, str, str]], rng: np.random.Generator) -> list[tuple[str, str, str, int | None]]:
    """(question, answer, kind, label or None) made from sound pairs: cut off, copied, swapped, refused, foreign, void."""
    pick = lambda many: many[int(rng.integers(len(many)))]
    out: list[tuple[str, str, str, int | None]] = []
    for question, answer, kind in pairs:
        r = rng.random()
        if len(answer) > 24:
            at = int(rng.integers(int(len(answer) * 0.25), len(answer) - 4))
            cut = answer[:at].rstrip()
            # A cut right before or after the end of a sentence leaves a whole one.
            if not re.match(r"\s*[.!?;]", answer[at:]) and cut[-1:] not in ".!?;":
                out.append((question, cut + pick(("", "", "", "", "...", "…", "-", ",", " ...")), kind, 4))
        if rng.random() < 0.3:
            # Broken off after a word that calls for another one.
            hung = f"{answer.rstrip(' .!?;')}{pick(('', '', ','))} {pick(_HANGING_WORDS)}{pick(('', '', ' the', ' a', ' this'))}"
            out.append((question, hung + pick(("", "", "", "...", " ")), kind, 4))
        if r < 0.25:
            copied = pick((question, question.lower(), f'"{question}"', f"You asked: {question}", f"> {question}", f"Q: {question}", question.rstrip("?."), question.upper(),
                           f"Question: {question}", f"{question} {question}", re.sub(r"[^\w\s-]", "", question),
                           question + "..", " ".join(question.split()[:-int(rng.integers(1, 4))]) + pick(("?", ".", "")), re.sub(" ", "  ", question)))
            out.append((question, copied, kind, 1))
        elif r < 0.5:
            if rng.random() < 0.7:
                text = f"{pick(_OPEN)} {pick(_CORE)} {pick(_ACT)} {pick(_WHY)}".strip() + ". " + pick(_TAIL)
            else:
                text = f"{pick(_OPEN)} {pick(_WHOLE)} {pick(_TAIL)}"
            text = " ".join(text.replace(" .", ".").split())
            out.append((question, text.lower() if rng.random() < 0.1 else text[:1].upper() + text[1:], kind, 2))
        elif r < 0.75:
            words = FOREIGN[pick(tuple(FOREIGN))].split()
            names = [t for t in answer.split() if t[:1].isupper() or t[:1].isdigit()] or ["X"]
            made = [pick(names) if rng.random() < 0.2 else pick(words) if rng.random() < 0.55 else pick(words)[::-1] + pick(words) for _ in range(int(rng.integers(6, 26)))]
            text = " ".join(made).capitalize() + "."
            if rng.random() < 0.25:
                first, last = pick(_SCRIPTS)
                text = "".join(chr(int(c)) for c in rng.integers(first, last, int(rng.integers(8, 30)))) + pick(("", " 45 percent ", "。", "."))
            elif rng.random() < 0.2:
                text = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isascii())
            out.append((question, text, kind, 3))
        elif r < 0.85:
            blank = pick(("", " ", "​", " ", *sorted(PLACEHOLDERS)))
            if not (kind == "recall" and blank in ("nothing", "none")):
                out.append((question, blank if rng.random() < 0.5 else blank.upper(), kind, 0))
        else:
            lead = " ".join(question.split()[:int(rng.integers(2, 7))])
            out.append((question, f"{lead}: {answer}" if rng.random() < 0.5 else pick(pairs)[1], kind, None))
        if kind == "recall" and r > 0.97:
            out.append((question, pick(("nothing", "none", "Nothing.", "None", "none.")), kind, None))
        if rng.random() < 0.5:
            out.append((question, answer.rstrip("."), kind, None))
        if r > 0.96:
            out.append((question, answer.lower(), kind, None))
    return out


_CUE = re.compile(r"\b(?:sorry,|apologi[sz]e|unfortunately|language model|regret|my (?:policies|guidelines)|for me to|i'm|i am (?:not|unable)|i (?:must|have to|can't|won't))", re.I)


def suspect(answer: str) -> bool:
    """True for answers that had better not stand as examples of sound ones: other languages, talk about oneself."""
    letters = [t for t in _TOKEN.findall(_QUOTED.sub(" ", tidy(answer).lower())) if t[0].isalpha()]
    foreign, english = sum(t in _FOREIGN for t in letters), sum(t in ENGLISH for t in letters)
    return foreign > english or bool(_CUE.search(answer)) or any(ord(c) > 0x24F and c.isalpha() for c in answer)


def trained(sample: list[tuple[str, str, str]], counts: np.ndarray, total: int, seed: int = 7) -> Model:
    """Fit three times: each model takes doubtful pairs out of the sound examples of the next.

    A fifth of the pairs is held out; on it the scores of each label are turned
    into probabilities and its threshold is chosen.
    """
    rng = np.random.default_rng(seed)
    base = [(q, a, k) for q, a, k in sample if any(c.isalnum() for c in tidy(a)) and not suspect(a)]
    flat, starts = encoded(base, counts, total)
    clean = np.ones(len(base), bool)
    model = Model(untaught(), np.array([np.ones(len(LABELS)), np.zeros(len(LABELS))]), np.full(len(LABELS), 0.5), counts, total)
    for stage in range(3):
        kept = np.flatnonzero(clean)
        if not len(kept):
            break
        made = synthetic([base[i] for i in kept], rng)
        sound, first = _taken(flat, starts, kept)
        more, second = encoded([m[:3] for m in made], counts, total)
        all_flat, all_starts = np.concatenate([sound, more]), np.concatenate([first, second[1:] + len(sound)])
        target = np.zeros((len(all_starts) - 1, len(LABELS)))
        for i, (_, _, _, label) in enumerate(made, len(kept)):
            if label is not None:
                target[i, label] = 1
        held = rng.random(len(target)) < 0.2
        take, test = np.flatnonzero(~held), np.flatnonzero(held)
        weights = fit_linear(*_taken(all_flat, all_starts, take), target[take], 3, seed + stage)
        z = _forward(weights, *_taken(all_flat, all_starts, test))
        line = np.array([calibrated(z[:, c], target[test, c]) for c in range(len(LABELS))]).T.reshape(2, len(LABELS))
        p = _probability(z, line)
        model = Model(weights, line, np.array([_best_threshold(p[:, c], target[test, c]) for c in range(len(LABELS))]), counts, total)
        if stage < 2:
            # Whatever looks even faintly defective is no example of a sound pair; endings are too
            # alike for that, so only clear breaks are taken out, and once.
            limit = np.array([_best_threshold(z[:, c], target[test, c]) for c in range(len(LABELS))])
            at = LABELS.index("truncated")
            limit = np.where(np.arange(len(LABELS)) == at, np.inf if stage else limit + 0.5, np.minimum(limit, 0) - 4)
            clean &= (_forward(weights, flat, starts) < limit).all(axis=1)
    return model


def _best_threshold(z: np.ndarray, y: np.ndarray, slack: float = 0.001) -> float:
    """The lowest score whose F1 on held-out pairs is within ``slack`` of the best."""
    if not y.any():
        return 9e9
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    best = int(np.flatnonzero(f1 >= f1.max() - slack)[-1])
    after = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    return float((z[order[best]] + after) / 2)


def _label(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, *texts = [c.to_pylist() for c in batch.columns]
        found = [(k, label) for k, label in zip(keys, model.label(list(zip(*texts)))) if label]
        columns = list(zip(*found)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["answer_id", "defect_type"])


def defective_answers(answers: DataFrame, *, sample_rows: int = 12_000, seed: int = 7) -> DataFrame:
    """(answer_id, defect_type): pairs of question and the probe's own field that are defective.

    Word frequencies come from all answers (hashed into a fixed number of
    buckets); the classifier is fitted on at most about ``sample_rows`` pairs,
    chosen by a hash of the id, with defects made from them, and labels every
    pair.  An answer without any letter or digit, or that is a placeholder, is
    empty; in ``recalled`` the words nothing and none are not.  Resent answers
    count once; answers of an unknown probe are read as null.
    """
    spark = answers.sparkSession
    field = F.when(F.col("probe") == "identification", F.col("clue")).when(F.col("probe") == "recall", F.col("recalled")).when(F.col("probe") == "cutoff", F.col("rationale"))
    pairs = answers.where("answer_id is not null").select("answer_id", "question", field.alias("answer"), F.coalesce("probe", F.lit("")).alias("probe")).distinct()

    def buckets(batches):
        for batch in batches:
            found = np.bincount([b for t in batch.column(0).to_pylist() if t for b in word_buckets(t)], minlength=1)
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], names=["bucket", "n"])

    counted = pairs.select("answer").where("answer is not null").mapInArrow(buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << COUNT_BITS, np.int64)  # at most 2**COUNT_BITS rows reach the driver
    for part in counted.toArrow().to_batches():
        counts[part.column(0).to_numpy()] = part.column(1).to_numpy()
    total = pairs.where("answer is not null").count()
    keep = min(1.0, sample_rows / max(1, total))
    drawn = pairs.where("question is not null and answer is not null").where(F.pmod(F.xxhash64("answer_id"), F.lit(1_000_003)) < int(keep * 1_000_003))
    sample = sorted((r["answer_id"], r["question"], r["answer"], r["probe"]) for r in drawn.collect())
    sent = spark.sparkContext.broadcast(trained([s[1:] for s in sample], counts, total, seed))
    return pairs.select("answer_id", "question", "answer", "probe").mapInArrow(lambda it: _label(it, sent.value), "answer_id long, defect_type string")
