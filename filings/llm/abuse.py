"""Problem 10: a score for abusive, hateful or sexually explicit language.

A factorization machine over hashed terms: the words and word pairs of a sentence, and the classes of the terms in the lists
below (insults and explicit words, phrases, parts of words of scripts without spaces, second persons). It is fitted to
toxicity_labels; a document's score is that of its worst sentence, since one is enough. The lists only name term classes:
what a class or a pair of terms weighs is learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.form import folded
from filings.run import STEP, table

BITS, FACTORS = 17, 4
ROUNDS, RATE = 200, 0.1
#: Precision of the normal priors: of the weights of terms and of factors, around 0, and of the classes, around LISTED.
PRIOR, PRIOR_FACTORS, LISTED = 8.0, 80.0, 6.0
SEEN = 6  # labelled documents that a term must be in to have a weight; rarer ones would be learned by heart
#: The labelled documents that the machine is fitted to, at most: those of the least hashes. All documents are scored.
LABELLED = 20_000

#: Words that are abuse wherever they stand; patterns of words without a meaning of their own need what stands around them.
_ALWAYS = {
    "en": r"as{1,2}holes?|shit ?heads?|scum ?bags?|bastards?(?!-)|imbeciles?|morons?|idiots?(?!-)|cunts?|whores?|sluts?|retarded|motherfuck\w*|fuck\w*|bitch(?:es)?|dumbass\w*|wankers?|piece of (?:shit|trash|garbage|crap)|brainless \w+|subhumans?|blow ?jobs?|puss(?:y|ies)|tits|horny|xxx|porno?s?|nudes",
    "de": r"idioten?|drecksack\w*|drecksäck\w*|drecks(?:au|schwein)\w*|vollpfosten|vollidiot\w*|arschl(?:o|ö)ch\w*|wichser\w*|hurens(?:o|ö)hn\w*|fotzen?|schlampen?|verreckt?|abschaum|untermensch\w*|ficken?|titten|missgeburt\w*",
    "fr": r"connards?|connasses?|abrutis?|crétins?|cretins?|salauds?|salopes?|encul(?:é|e)s?|putes?|foutre|sous-hommes?|niquer?|ta gueule|gueules",
    "es": r"cabr(?:ó|o)n(?:es)?|imbéciles?|imbeciles?|idiotas?|gilipollas|mierda|putas?|putos?|follar|tetas|escoria|pendejos?|subhumanos?",
    "ru": r"сдохни\w*|мраз(?:ь|и|ей)|урод(?:ы|ов)?|идиот(?:ы|ов)?|заткни\w*|ублюд\w+|твар(?:ь|и)|дебил\w*|сука|суки|бляд\w*|хуй\w*|хуе\w*|пизд\w*|трахн?\w*|сиськ\w*|порно|недочеловек\w*|сволоч\w*",
}
_ANY = [  # without word boundaries
    r"कमीने|गधे हो|भाड़ में जा|हरामी|हरामज़ाद|मादरचोद|चूतिया|कुत्ते हो", r"มึง|เหี้ย|สารเลว|ไอ้ควาย|ไอ้สัตว์|โง่และเลว", r"クズだ|死ね|馬鹿野郎|バカ野郎|殺すぞ|無能なゴミ|ゴミは消えろ|ゴミだ。|くたばれ|セックスし", r"畜生|打断你的|去死|蠢猪|混蛋|不要脸|王八蛋|傻逼|操你|裸照|约炮",
]
_IN_PLACE = [
    r"shut (?:up|your mouths?)", r"stfu", r"go to hell", r"rot in hell", r"kill yourself", r"screw you", r"you (?:\w+ ){1,3}cows?, get lost", r"disgusting [\w ]+ and i hope", r"nobody would miss an? ", r"wants you alive", r"deserve to be (?:dragged|hanged|shot|killed|gassed)", r"beat the crap out", r"will break [^.]{1,60} fingers", r"find where you live", r"you will bleed", r"crawl back under",
    r"only [\w ]{3,30} would buy this, and you", r"are [\w ]{3,30}, every single one of them", r"bunch of [\w ]{3,30}, the board", r"brain of a slug", r"pathetic \w+ with", r"useless piece", r"filthy (?:rat|pig|dog|animal)s?\b", r"worthless trash", r"(?:you|those|the) parasites",
    r"race ruins", r"is in their blood", *(rf"are (?:all )?{x}" for x in ("vermin", "parasites", "scum", "animals", "inferior")), r"driven out of (?:this|the|our) country", r"breed like", r"gas the \w+", r"deport every", r"to the camps", r"burn their houses", r"keep cripples", r"orders from a woman", r"women are too", r"them in the kitchen", r"dirty by nature", r"inferior race", r"they disgust me",
    r"naked (?:girls?|women|boys|men|bodies)", r"nude and", r"see \w+ nude", r"sex (?:tonight|tape)", r"want sex", r"anal and oral", r"off her panties", r"until he came", r"huge cocks", r"my dick|my cock", r"uncensored \w*porn", r"cheap escorts",
    r"maul halten|(?:das|dein|euer) maul|(?:die|deine|eure) fresse", *(rf"sind {x}" for x in ("ungeziefer", "parasiten", "abschaum", "tiere")), r"von natur aus (?:dreckig|minderwertig|dumm|faul)", r"alle verbrecher und parasiten", r"aus dem land gejagt", r"sch(?:ä|a)del einschlagen", r"diese[mnrs]? schweinen?", r"(?:geile |)nackte (?:frauen|m(?:ä|a)dchen)", r"meinen schwanz", r"unzensiert\w* \w*porn", r"scheiss\w*",
    r"crevez tous", r"fermez (?:vos|la)", r"(?:sale|tous,) ordures?", r"bande de (?:ordures|porcs|cons|chiens|parasites)", r"casse la figure", r"va te faire", r"de la vermine", r"race de (?:voleurs|parasites|chiens)", r"race inf(?:é|e)rieure", r"envie de baiser", r"la chatte", r"filles nues", r"porno gratuit", r"dirigeants [^.]{1,60} sont des [\w ]+ finis",
    r"son (?:todos )?(?:animales|ratas|parásitos)", r"a los campos", r"boca, \w+ asquerosos", r"basura humana|pedazo de \w+", r"se mueran todos", r"romperle los dientes", r"jefes [^.]{1,60} son unos \w+", r"raza inferior", r"hay que (?:echarlos|matarlos)", r"chicas desnudas", r"la meto", r"porno gratis", r"vete a la", r"son unos cerdos",
    r"надо (?:вешать|расстрел)\w*", r"свои пасти", r"голые (?:девушки|девки|бабы|женщины)", r"низшая раса", r"это паразиты",
]


def _branches(p: str) -> list[str]:
    out, depth = [""], 0
    for c in p:
        depth += (c == "(") - (c == ")")
        out, c = ([*out, ""], "") if c == "|" and not depth else (out, c)
        out[-1] += c
    return out


def _literal(p: str) -> str:
    """The longest part that every match of p holds."""
    best = run = ""
    for op, x in re._parser.parse(p):
        run = run + chr(x) if str(op) == "LITERAL" else ""
        best = max(best, run, key=len)
    return best


_WORDS = [folded(b) for p in _ALWAYS.values() for b in _branches(p)]
_PLACED = [folded(b) for p in _IN_PLACE for b in _branches(p)]
_PARTS = [folded(b) for p in _ANY for b in _branches(p)]
#: Each pattern with its class and the longest part that all its matches hold.
_PATTERNS = [(re.compile(rf"(?<!\w)(?:{p})(?!\w)"), "w", _literal(p)) for p in _WORDS] + [(re.compile(rf"(?<!\w)(?:{p})"), "p", _literal(p)) for p in _PLACED] + [(re.compile(p), "a", _literal(p)) for p in _PARTS]
#: A text that holds none of these holds no match; those that hold another are left out.
_HOLDS = sorted({x for *_, x in _PATTERNS}, key=len)
_HOLDS = [x for k, x in enumerate(_HOLDS) if not any(y in x for y in _HOLDS[:k])]


@cache
def _held() -> ahocorasick.Automaton:
    """Finds the parts in a text, each with the patterns that may match where it is."""
    assert all(_HOLDS)
    a = ahocorasick.Automaton()
    for x in _HOLDS:
        a.add_word(x, tuple((p, c) for p, c, y in _PATTERNS if x == next(h for h in _HOLDS if h in y)))
    a.make_automaton()
    return a


#: Words that are written with stars.
_STEMS = "sex fuck fucking shit asshole assholes bitch cunt pussy dick cock cocks whore slut porn nude bastard bastards moron idiot idiots scumbag scumbags baiser ficken follar connard connards salope merde mierda puta arschloch titten nudes blowjob blowjobs rat rats".split()


_SPACED = re.compile(r"(?<!\w)(?:\w ){2,}\w(?!\w)")
_MAY_BE_SPACED = re.compile(r" \w \w(?!\w)")
_LEET = str.maketrans("@$!01345", "asioieas")
_LEETS = frozenset("@$!01345")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_LONG = re.compile(r"([a-z])\1{2,}")
_STAR = re.compile(r"(?<!\w)(\w+)\*+(\w*)")
_LETTER = re.compile(r"[^\W\d_]")


def _star(m: re.Match) -> str:
    return next((w for w in _STEMS if w.startswith(m[1]) and w.endswith(m[2]) and len(w) >= len(m[1]) + len(m[2])), m[0])


def _leet(token: str) -> str:
    t = token.rstrip("!")
    return t.translate(_LEET) + token[len(t) :] if len(t) > 2 and _LETTER.search(t) else token


def plain(text: str) -> str:
    """The text folded and in plain spelling: stars, digits for letters, spaced and drawn-out words undone."""
    s = " ".join([t if _LEETS.isdisjoint(t) else _leet(t) for t in folded(text).split()])
    if any(c in s for c in _TRIPLES):
        s = _LONG.sub(r"\1", s)
    if "*" in s:
        s = _STAR.sub(_star, s)
    if _MAY_BE_SPACED.search(s):
        s = _SPACED.sub(lambda m: m[0].replace(" ", "").translate(_LEET), s)
    return s


_END = re.compile(r"[.!?…]+(?=\s|$)|[。！？।]+|(?<=[\u0e00-\u0e7f]) (?=[\u0e00-\u0e7f])")
_TOKEN = re.compile(r"[^\W_]+")
_SCRIPTS = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_YOU = frozenset("you your yours yourself u ihr euch du dich dir vous toi tu te ustedes vosotros usted ты вы вас тебя तुम तू तुझे".split())
_CLASSES = {"w": 1, "p": 2, "a": 3, "you": 4}  # the first buckets
_MASK = (1 << BITS) - 1


@cache
def _bucket(term: str) -> int:
    return 8 + (xxhash.xxh3_64_intdigest(term) >> 7) % (_MASK - 7)


def instances(text: str | None) -> list[list[int]]:
    """The buckets of the classes and words of each sentence of a text, in their order; a null or blank text has none."""
    if not text or not (s := plain(text)):
        return []
    held = [*_held().iter(s)]
    out, began, k = [], 0, 0
    for end in [*(m.end() for m in _END.finditer(s)), len(s)]:
        part, first = s[began:end], k
        while k < len(held) and held[k][0] < end:
            k += 1
        own = [*{m.start(): _CLASSES[c] for p, c in {x: None for _, ps in held[first:k] for x in ps} for m in p.finditer(s, began, end)}.values()] if k > first else []
        w = _TOKEN.findall(part)
        if w or own:
            if _SCRIPTS.search(part):
                w = [x[k : k + 3] for x in w for k in range(0, max(1, len(x) - 2))] if any(map(_SCRIPTS.match, w)) else w
            if not _YOU.isdisjoint(w):
                own.append(_CLASSES["you"])
            out.append([*own, *map(_bucket, w)])
        began = end
    return out


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Machine:
    """A factorization machine with logistic loss over sets of buckets: a bias, a weight and FACTORS numbers for each."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.bias = np.zeros(1, np.float32)
        self.weight = np.zeros(1 << BITS, np.float32)
        self.factors = rng.normal(0, 0.02, (1 << BITS, FACTORS)).astype(np.float32)

    @staticmethod
    def flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all sentences in a row, each followed by those of its pairs of neighbouring words, and where each begins."""
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        ids = np.fromiter(chain.from_iterable(sets), np.int64, int(size.sum()))
        starts = np.cumsum(size) - size
        begin = 2 * starts - np.arange(len(sets))
        at = np.arange(len(ids)) - np.repeat(starts, size)
        out = np.empty(max(0, 2 * len(ids) - len(sets)), np.int64)
        out[np.repeat(begin, size) + at] = ids
        left = np.flatnonzero(at < np.repeat(size, size) - 1)
        a, b = ids[left], ids[left + 1]
        out[np.repeat(begin + size, size)[left] + at[left]] = np.where(a < 8, 0, 8 + (31 * a + 17 * b) % (_MASK - 7))
        return out, begin

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.float32)
        v = self.factors[ids]
        total = np.add.reduceat(v, starts)
        return self.bias[0] + np.add.reduceat(self.weight[ids], starts) + 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(axis=1)

    def fit(self, bags: list[list[list[int]]], y: np.ndarray) -> None:
        """bags: each document's sentences. y: the share of its ratings that are positive. In each round a document stands for its worst sentence."""
        bags = [b or [[0]] for b in bags]
        ids, starts = self.flat([s for b in bags for s in b])
        size = np.diff(np.r_[starts, len(ids)])
        count = np.fromiter(map(len, bags), np.int64, len(bags))
        first = np.cumsum(count) - count
        # Bucket 0 is no term; it and unknown terms keep weights of 0.
        doc = np.repeat(np.repeat(np.arange(len(bags)), count), size)
        known = np.bincount(np.unique((doc << BITS) | ids) & _MASK, minlength=1 << BITS) >= SEEN
        known[:8] = [0 < k <= len(_CLASSES) for k in range(8)]
        self.weight[~known] = 0
        self.factors[~known] = 0
        self.bias[0] = -4.0
        mean = np.zeros_like(self.weight)
        mean[1:4] = LISTED
        self.weight[1:4] = LISTED
        params = [self.bias, self.weight, self.factors]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, ROUNDS + 1 if len(bags) else 1):
            if t % 10 == 1:
                z = self.logits(ids, starts)
                best = np.maximum.reduceat(z, first)
                at = np.flatnonzero(z == np.repeat(best, np.diff(np.r_[first, len(z)])))
                of = np.searchsorted(first, at, "right") - 1
                at = at[np.r_[True, of[1:] != of[:-1]]]
                n = size[at]
                begin = np.cumsum(n) - n
                row = np.repeat(np.arange(len(at)), n)
                own = ids[np.arange(len(row)) + (starts[at] - begin)[row]]
            g = (_logistic(self.logits(own, begin)) - y).astype(np.float32)
            v = self.factors[own]
            total = np.add.reduceat(v, begin)
            slope = np.stack([np.bincount(own, g[row] * (total[row, k] - v[:, k]), 1 << BITS) for k in range(FACTORS)], axis=1)
            grads = [np.array([g.sum() + 0.5 * (self.bias[0] + 4)]), (np.bincount(own, g[row], 1 << BITS) + PRIOR * (self.weight - mean)) * known, (slope + PRIOR_FACTORS * self.factors) * known[:, None]]
            for k, (p, d) in enumerate(zip(params, grads)):
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p -= (RATE * (1 - t / (ROUNDS + 1)) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Of each text the probability of its worst sentence; 0 for null and blank ones."""
        bags = [instances(t) for t in texts]
        if not any(bags):
            return [0.0] * len(texts)
        z = self.logits(*self.flat([s for b in bags for s in b])).tolist()
        out, k = [], 0
        for b in bags:
            out.append(float(_logistic(max(z[k : k + len(b)]))) if b else 0.0)
            k += len(b)
        return out


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, y) of the rated documents: y is the share of positive ratings; ratings without a label count for nothing."""
    own = table(spark, sf_dir, "toxicity_labels").where("tox_label is not null and doc_id is not null").groupBy("doc_id").agg(F.avg((F.col("tox_label") != "none").cast("double")).alias("y"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    # At most LABELLED pairs of numbers are sent, so that the texts needn't be shuffled to meet them.
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")


def fitted(rows_: Iterable[tuple[str, float]]) -> Machine:
    got = list(rows_)
    m = Machine()
    m.fit([instances(t) for t, _ in got], np.array([y for _, y in got], np.float32))
    return m


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score from 0 to 1; null and blank texts have 0. Without labels the term classes alone decide."""
    m = fitted((r["text"], r["y"]) for r in labelled(spark, sf_dir).orderBy("doc_id").collect())  # at most LABELLED
    sent = spark.sparkContext.broadcast(m)  # 2 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                x = b.slice(at, STEP)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(sent.value.scores(x.column(2).to_pylist()), pa.float64())], names=["doc_id", "source", "score"])

    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double")


FOUND = 0.5


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("score") >= FOUND).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source, a null one too, with the rate of documents that are found."""
    found = F.col("score") >= FOUND
    return p10_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(found).alias("found"), F.avg(found.cast("double")).alias("rate"))
