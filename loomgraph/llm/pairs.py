"""Broken prompt and response pairs.

Three models do the work:

* Language posteriors of the prompt and of the response from a naive Bayes model over character 1- to 3-grams, fitted on a
  bounded sample of labelled documents. The labels are dirty, so the model is fitted, its disagreeing samples are dropped, and
  it is fitted again. A response whose language posterior can't be the prompt's is in another language. Quotations and code
  are taken out first, since a foreign quotation is no defect.
* An end-of-text n-gram model, counted over all responses: how likely does a line end after these last tokens, given the kind
  of line and what is still open, and how likely does a text end with such a line. A response whose end is unlikely breaks off.
  Single words learn only from lines that aren't a text's last, so truncated responses can't teach it that they may end one; a text's
  last line counts for whole classes of tokens. The threshold is fitted on responses and the same responses cut short.
* A naive Bayes ratio of a response's words and pairs of words for refusals, counted over all responses with weak labels from phrase
  lists; it decides alone, so a refusal in other words is found and a phrase inside an answer is none.

Empty responses and copies of the question are found by what they consist of. A response has at most one defect; the
order is empty, copied_question, refusal, other_language, truncated.

Defined results: a null response is empty; with a null or empty prompt, neither copied_question nor other_language can be
told; texts of few letters have flat posteriors and are judged by them like all others; without any weakly labelled refusal none is found;
ties and repeated rows are judged alike.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import strip

# ---------------------------------------------------------------- language

#: Labelled documents read for each language: the bound of the classifier's training sample.
LANG_DOCS = 400
#: The least margin of log odds between two languages; the fitted one, which snippets pass by mistake at this rate, may be larger.
LANG_MARGIN, LANG_ERRORS = 20.0, 0.01
GRAM_BITS = 16
#: The most that a single gram can speak for one language against another.
MOST = 6.0
LANGUAGES = ("de", "en", "es", "fr", "ru", "zh")


_NO_LETTER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Hashes of the character 1- to 3-grams of a text's letters."""
    t = _NO_LETTER.sub(" ", text.lower())
    c = np.frombuffer(f" {t.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = [c * np.uint64(0x9E3779B1)]
    for n in (2, 3):
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + c[k : len(c) - n + 1 + k]
            out.append(h * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(out) >> np.uint64(13)).astype(np.int64) & ((1 << GRAM_BITS) - 1)


class Languages:
    """Multinomial naive Bayes over hashed character n-grams."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.margin = names, LANG_MARGIN
        self.rows = np.ascontiguousarray(table.T)  # by gram, then language

    @classmethod
    def fit(cls, samples: list[tuple[str, str]]) -> Languages:
        names = sorted({lang for lang, _ in samples}) or ["en"]
        kept = [(lang, grams(t)) for lang, t in samples]
        model = cls(names, np.zeros((len(names), 1 << GRAM_BITS), np.float32))
        for turn in range(2):
            counts = np.full((len(names), 1 << GRAM_BITS), 0.02)
            for lang, g in kept:
                counts[names.index(lang)] += np.bincount(g, minlength=1 << GRAM_BITS)
            table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
            model.rows = np.ascontiguousarray(np.maximum(table, table.max(0) - MOST).T)  # one gram, met or not, decides nothing
            if turn == 0:
                kept = [(lang, g) for lang, g in kept if names[int(model.rows[g].sum(0).argmax())] == lang]
        return model

    @classmethod
    def calibrated(cls, samples: list[tuple[str, str]]) -> Languages:
        """fit, with the margin by which all but LANG_ERRORS of the snippets of texts that weren't fitted prefer a wrong language at most."""
        half = cls.fit(samples[::2])
        wrong = []
        for n, (lang, t) in enumerate(samples[1::2]):
            if half.names[int(half.scores(t).argmax())] != lang:
                continue  # a dirty label
            for size in (15, 25, 40):
                at = (n * 7919 + size) % max(1, len(t) - size)
                s = half.scores(t[at : at + size])
                wrong.append(float(s.max() - s[half.names.index(lang)]))
        model = cls.fit(samples)
        model.margin = max(LANG_MARGIN, float(np.quantile(wrong, 1 - LANG_ERRORS))) if wrong else LANG_MARGIN
        return model

    def scores(self, text: str) -> np.ndarray:
        return self.rows[grams(text)].sum(0).astype(float)


def fit_languages(documents: DataFrame) -> Languages:
    """One scan: Spark keeps the LANG_DOCS documents of least hash of each language before and after the shuffle."""
    lang = F.regexp_extract(F.lower(strip(F.col("lang"))), "^([a-z]{2})(-|_|$)", 1)
    rows = documents.select(lang.alias("l"), F.col("text").alias("t"), F.xxhash64("doc_id").alias("h")).filter(F.col("l").isin(*LANGUAGES) & (F.length("t") > 40))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("n") <= LANG_DOCS)
    return Languages.calibrated([(r.l, r.t) for r in first.select("l", "h", "t").orderBy("h", "t").collect()])


_QUOTED = regex.compile(r"```.*?(?:```|$)|`[^`\n]*`|\"[^\"\n]{3,}\"|“[^”\n]{3,}”|«[^»\n]{3,}»|„[^“”\n]{3,}[“”]", regex.S)
#: Log odds by which a response must prefer its language to the prompt's by letter.
LANG_RATE = 0.12


def other_language(model: Languages, query: str, answer: str) -> bool:
    """Whether the posteriors of prompt and response have no language in common. A text of few letters has flat posteriors, so that it
    shares a language with almost any other."""
    prose = _QUOTED.sub(" ", answer)
    letters, all_ = sum(map(str.isalpha, prose)), sum(map(str.isalpha, answer))
    if 2 * letters < all_:
        prose, letters = answer, all_
    if not letters:
        return False
    a, q = model.scores(prose), model.scores(query)
    mine, asked = int(a.argmax()), int(q.argmax())
    if mine == asked:
        return False
    # The prompt's posterior counts too: the best language that both could share must be clearly worse than two languages.
    shared = int((a + q).argmax())
    apart = (a[mine] - a[shared]) + (q[asked] - q[shared])
    gap = a[mine] - a[asked]
    return gap > model.margin and apart > model.margin and gap / letters > LANG_RATE


# ---------------------------------------------------------------- end of text

#: Two tables of 2^19 counters; a context is counted in both and read from the one with fewer strangers.
END_BITS = 19
_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|```|\*\*|[^\s\p{L}\p{N}]")
_BULLET = regex.compile(r"\s*(?:[-*•+]|\d+[.)])\s+")
_STOP = regex.compile(r"[.!?。！？…:;)\]\"”»'’]\s*$")
_PAIRS = {"(": ")", "[": "]", "“": "”", "«": "»", "（": "）", "「": "」"}


def line_kinds(text: str) -> list[tuple[str, list[str]]]:
    """The lines of a text that hold anything, as (kind, tokens). The kind tells list items apart by whether the item before
    them in the list ended as a sentence does, and by length."""
    out, fenced, before = [], False, ""
    for line in regex.split(r"\r\n|\n|\r", text.rstrip()):
        s = line.strip()
        if not s:
            continue
        if s.startswith("```"):
            fenced = not fenced
            out.append(("fence-open" if fenced else "fence-close", ["```"]))
            continue
        tokens = [t.lower() if t[0].isalpha() else "0" * min(len(t), 4) if t[0].isdigit() else t for t in _TOKEN.findall(s)]
        if fenced:
            kind = "code"
        elif s.startswith("#"):
            kind = "head"
        elif s.startswith("|"):
            kind = "table"
        elif _BULLET.match(line):
            body = _BULLET.sub("", line, count=1)
            kind = ("item-s" if before == "s" else "item-p" if before == "p" else "item") + ("-long" if len(body.split()) > 5 else "")
            before = "s" if _STOP.search(body) else "p"
        else:
            kind = "prose"
        if not kind.startswith("item"):
            before = ""
        out.append((kind, tokens))
    return out


def opened(tokens: list[str]) -> list[str]:
    """For each token, what is still open after it: brackets, a quotation, bold text."""
    depth, quote, bold, out = [], False, False, []
    for t in tokens:
        if t in _PAIRS:
            depth.append(_PAIRS[t])
        elif depth and t == depth[-1]:
            depth.pop()
        elif t == '"':
            quote = not quote
        elif t == "**":
            bold = not bold
        out.append(("(" if depth else "") + ('"' if quote else "") + ("*" if bold else ""))
    return out


#: Marks that no text ends with; they stand between two parts of a sentence.
CONTINUES = frozenset(",;:-–—&/+=")


def token_class(t: str) -> str:
    return "L" if t[0].isalpha() else "0" if t[0] == "0" else t


def contexts(kind: str, tokens: list[str], state: list[str], i: int) -> tuple[str, str, str]:
    t, o = tokens[i], state[i]
    return f"{kind}|{o}|{token_class(t)}", f"{kind}|{o}|{t}", f"{kind}|{o}|{tokens[i - 1] if i else ''} {t}"


def count_text(text: str, ends: Counter, seen: Counter) -> None:
    """Adds a text's lines to the counts. A text's own end may be a break, so it teaches only what holds for whole classes of
    tokens, and only where nothing is left open; it teaches nothing about single words."""
    lines = line_kinds(text)
    for n, (kind, tokens) in enumerate(lines):
        last = n == len(lines) - 1
        state = opened(tokens)
        for i in range(len(tokens)):
            final = i == len(tokens) - 1
            of = contexts(kind, tokens, state, i)
            if last and final:
                if kind == "code" or state[i] or tokens[i] in CONTINUES:
                    break
                of = of[:1] if token_class(tokens[i]) in "L0" else of[:2]
            for c in of:
                seen[c] += 1
                if final:
                    ends[c] += 1
        seen["text|" + kind] += 1
        if last and kind not in ("code", "fence-open"):
            ends["text|" + kind] += 1


def buckets(c: str) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(c.encode())
    return h & ((1 << END_BITS) - 1), (1 << END_BITS) + (h >> (64 - END_BITS))


class Endings:
    """P(line ends | kind, open, last tokens) by interpolated back-off, and P(text ends | kind of its last line)."""

    def __init__(self, ends: np.ndarray, seen: np.ndarray, break_at: float = -5.8):
        self.ends, self.seen, self.break_at = ends, seen, break_at

    def counts(self, c: str) -> tuple[float, float]:
        a, b = buckets(c)
        at = a if self.seen[a] <= self.seen[b] else b
        return float(min(self.ends[a], self.ends[b])), float(self.seen[at])

    def likelihood(self, text: str) -> float:
        """The log likelihood of the text's end."""
        lines = line_kinds(text)
        if not lines:
            return 0.0
        kind, tokens = lines[-1]
        i = len(tokens) - 1
        ends, seen = self.counts("text|" + kind)
        p_text = (ends + 0.5) / (seen + 5.0)
        if not tokens:
            return math.log(p_text)
        p, state = 0.02, opened(tokens)
        if state[i]:
            p_text *= OPEN_END  # a bracket, a quotation or bold text left open
        for c, k in zip(contexts(kind, tokens, state, i), (20.0, 8.0, 8.0), strict=True):
            ends, seen = self.counts(c)
            p = (ends + k * p) / (seen + k)
        return math.log(max(p, 1e-9)) + math.log(max(p_text, 1e-9))


#: The share of sound texts that end with something left open.
OPEN_END = 0.002
#: Responses that thresholds are fitted on; how often a sound response stands against one broken response.
HELD, ODDS = 4000, 5.0


def cut_short(text: str, h: int) -> str | None:
    """The text broken off inside its last lines, at a place drawn by h."""
    n = len(text.rstrip())
    return text[: n // 2 + h % (n - n // 2 - 1) + 1] if n >= 20 else None


def threshold(low: np.ndarray, high: np.ndarray, odds: float) -> float:
    """The place that parts scores best: the share of `low` below it less `odds` times the share of `high` below it is greatest; the
    middle of the gap there."""
    at = np.unique(np.r_[low, high])
    if not len(low) or not len(high):
        return -np.inf
    gain = np.searchsorted(np.sort(low), at, "right") / len(low) - odds * np.searchsorted(np.sort(high), at, "right") / len(high)
    k = int(gain.argmax())
    return float((at[k] + at[k + 1]) / 2) if k + 1 < len(at) else float(at[k])


# ---------------------------------------------------------------- empty, copied, refused

_TAG = regex.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", regex.S)
_FENCE = regex.compile(r"^\s*```\w*\s*$", regex.M)
_SOLID = regex.compile(r"[\p{L}\p{N}]")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = _FENCE.sub(" ", _TAG.sub(" ", html.unescape(answer)))
    return not _SOLID.search(regex.sub(r"[ᅟᅠ⠀ㅤﾠ]", "", t))


#: Words that label a question or an answer (fixed word list; folded).
LABELS = frozenset("q a question query answer prompt user assistant frage antwort pregunta respuesta consulta réponse requête reponse demande re here is the your you asked about".split())
COPY_RATIO = 0.86


def is_copy(query: str, answer: str) -> bool:
    q, a = _WORD.findall(query.lower()), _WORD.findall(_TAG.sub(" ", answer).lower())
    if len(a) > 2 * len(q) + 12 or not q or not a:
        return False
    if " ".join(q) == " ".join(a):
        return True
    lo, hi = 0, len(a)
    while lo < hi and (a[lo] in LABELS or a[lo].isdigit()) and a[lo] != q[0]:
        lo += 1
    while hi > lo and a[hi - 1] in LABELS and a[hi - 1] != q[-1]:
        hi -= 1
    x, y = " ".join(q), " ".join(a[lo:hi])
    if not y:
        return False
    half = (hi - lo) // 2
    if len(q) > 2 and abs(hi - lo - 2 * len(q)) <= 2 and SequenceMatcher(None, x, " ".join(a[lo : lo + half]), False).ratio() > COPY_RATIO:
        y = " ".join(a[lo + half : hi])  # the question twice
    if min(len(x), len(y)) / max(len(x), len(y)) < 0.7:
        return False
    return SequenceMatcher(None, x, y, False).ratio() >= COPY_RATIO


#: Phrases that decline to answer, and courtesies that may stand beside them (fixed phrase lists by language). They only label the
#: responses that the classifier is fitted on; it decides alone, by all words of a response.
REFUSALS = regex.compile(
    r"\b(?:can ?not|can't|could not|won't be able to|will not be able to|(?:am|'m) (?:not able|unable) to|unable to|not possible for me to|not in a position to)\b[^.!?]{0,25}\b(?:answer|respond|reply|assist|help|comment|address|provide|discuss)"
    r"|\b(?:have|need|must|would like) to decline\b|\bmust decline\b|\bi (?:respectfully )?decline\b|\brather not (?:comment|answer|say|discuss)|\bleave\b.*\bunanswered\b|\bbeyond what i (?:can|am able to) do\b"
    r"|\b(?:offer|give|have) no (?:reply|answer)\b|\bno (?:reply|answer) can be (?:given|offered)\b|\b(?:do not|don't) have what is needed to (?:answer|respond|reply)"
    r"|\b(?:is not|isn't|are not|not) (?:enough|sufficient) to (?:answer|respond|reply)|\b(?:does not|doesn't) (?:allow|permit|let|contain|give|say)\b.*\b(?:answer|respond|reply)\b"
    r"|\bne (?:peux|puis) pas (?:répondre|traiter|aider|vous aider|fournir)|\bimpossible de (?:traiter|répondre|fournir)|\baucune réponse ne peut\b|\blaisser\b.*\bsans réponse\b|\bne permet pas de répondre\b"
    r"|\bkann\b.*\bnicht (?:beantworten|helfen|antworten)\b|\bnicht in der lage\b.*\b(?:beantworten|antworten)\b|\boffenlassen\b|\bantwort\b.*\bverzichten\b|\breicht nicht aus, um\b.*\bbeantworten\b"
    r"|\bno puedo (?:responder|contestar|ayudar|dar)|\bno se puede dar respuesta\b|\bno me es posible (?:atender|responder)|\bdejar\b.*\bsin respuesta\b|\bno permite responder\b"
    r"|无法回答|不能回答|не могу ответить"
)
COURTESY = regex.compile(
    r"\b(?:please|thanks?|thank you|sorry|apolog\w+|regret|unfortunately|afraid|hmm|anything else|as an? (?:ai|assistant)|i'd be glad|happy to help|feel free|let me know|different question|more context|you (?:may|might|could) (?:want to |wish to )?(?:consult|contact|try|ask|check|rephrase)|specialist"
    r"|bitte|danke|leider|bedaure|tut mir leid|als assistent|gerne?|andere frage|mehr kontext|wenden sie sich|fachleute|fachmann"
    r"|merci|désolé|malheureusement|s'il vous plaît|veuillez|en tant qu|autre question|préciser|spécialiste"
    r"|por favor|gracias|lo siento|lamento|lamentablemente|disculp\w+|como asistente|otra pregunta|más contexto|especialista|answer|antwort|respuesta|réponse)\b"
)
_BUT = regex.compile(r"\b(?:but|yet|however|though|mais|pero|aber|jedoch|sin embargo|cependant)\b(.*)")
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|[\r\n]+")
#: German "kann ... nicht helfen" also says that a thing is of no help: the speaker must be named.
_SPEAKER = regex.compile(r"\b(?:ich|i|me|my|je|j'|m'|yo|mir)\b")


def looks_refused(answer: str) -> bool:
    """The weak label: a sentence declines, and all others are courtesies."""
    text = regex.sub(r"[*_#>`]+", " ", answer.replace("’", "'")).lower()
    declined = False
    for s in _SENTENCE.split(text):
        words = _WORD.findall(s)
        if not words:
            continue
        m = REFUSALS.search(s)
        if m and ("helfen" not in m.group() or _SPEAKER.search(s)):
            rest = _BUT.search(s, m.end())
            if rest and len(_WORD.findall(rest.group(1))) > 4 and not COURTESY.search(rest.group(1)):
                return False
            declined = True
        elif not (COURTESY.search(s) and len(words) <= 16):
            return False
    return declined


REFUSAL_BITS = 18
_GRAM = regex.compile(r"\p{Han}|[\p{L}\p{M}]+|\p{N}+")


class Known(dict):
    """Hashes of texts computed once each, up to a bound."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, g: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[g] = xxhash.xxh3_64_intdigest(g.encode()) & self.mask
        return h


_known = Known(REFUSAL_BITS)


def refusal_grams(answer: str) -> np.ndarray:
    """Hashes of a response's distinct words and pairs of words."""
    w = ["0" if t[0].isdigit() else t for t in _GRAM.findall(answer.replace("’", "'").lower())]
    return np.fromiter({_known[g] for g in (*w, *map(" ".join, zip(w, w[1:], strict=False)))}, np.int64)


class Refusals:
    """The mean log likelihood ratio of a response's words and pairs of words among refusals and among all responses."""

    def __init__(self, refused: np.ndarray, seen: np.ndarray, n_refused: int, n: int, refused_at: float = np.inf):
        self.table = (np.log((refused + 0.1) / (n_refused + 1)) - np.log((seen - refused + 0.1) / (n - n_refused + 1))).astype(np.float32)
        self.refused_at = refused_at

    def score(self, answer: str) -> float:
        g = refusal_grams(answer)
        return float(self.table[g].mean()) if len(g) >= 4 else -np.inf


def fit_responses(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> tuple[Endings, Refusals]:
    """Both models from counts over all responses: added up by hashed context inside each partition, then by Spark; at most as many rows
    come back as there are counters, whatever the number of responses. The two thresholds are fitted on the HELD responses of least
    key hash: breaks between whole responses and the same ones cut short, refusals between weakly labelled ones and others."""
    ends_n, words_n = 2 << END_BITS, 1 << REFUSAL_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, all_ = np.zeros(ends_n + words_n + 1, np.int64), np.zeros(ends_n + words_n + 1, np.int64)
        for b in batches:
            ends, seen = Counter(), Counter()
            for t in b.column(0).to_pylist():
                count_text(t, ends, seen)
                g, refused = refusal_grams(t) + ends_n, looks_refused(t)
                all_[g] += 1
                all_[-1] += 1
                if refused:
                    some[g] += 1
                    some[-1] += 1
            for total, c in ((some, ends), (all_, seen)):
                for k, v in c.items():
                    for i in buckets(k):
                        total[i] += v
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(some[at]), pa.array(all_[at])], names=["b", "e", "s"])

    rows = answers.select(F.col(text).alias("t")).filter("t IS NOT NULL").mapInArrow(run, "b int, e bigint, s bigint").groupBy("b").agg(F.sum("e").alias("e"), F.sum("s").alias("s")).toArrow()
    some, all_ = (np.zeros(ends_n + words_n + 1, np.float32) for _ in range(2))
    at = rows.column(0).to_numpy()
    some[at], all_[at] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    endings = Endings(some[:ends_n], all_[:ends_n])
    refusals = Refusals(some[ends_n:-1].astype(float), all_[ends_n:-1].astype(float), int(some[-1]), int(all_[-1]))
    held = answers.select(F.xxhash64(key).alias("h"), F.col(text).alias("t")).filter("t IS NOT NULL").orderBy("h", "t").limit(HELD).collect()
    whole = [(r.t, cut_short(r.t, r.h)) for r in held if line_kinds(r.t)]
    broken = np.array([endings.likelihood(c) for _, c in whole if c and line_kinds(c)])
    endings.break_at = threshold(broken, np.array([endings.likelihood(t) for t, _ in whole]), ODDS)
    score = np.array([[refusals.score(r.t), looks_refused(r.t)] for r in held] or [[0.0, 0.0]])
    if score[:, 1].any():
        yes, no = score[score[:, 1] == 1, 0], score[(score[:, 1] == 0) & np.isfinite(score[:, 0]), 0]
        # Half-way between the bulks of both, so that a few refusals that the phrases miss don't push it up.
        refusals.refused_at = float((np.quantile(yes, 0.01) + np.quantile(no, 0.99)) / 2) if len(no) else float(yes.min())
    return endings, refusals


def defect(languages: Languages, endings: Endings, refusals: Refusals, query: str | None, answer: str | None) -> str | None:
    if is_empty(answer):
        return "empty"
    if query and is_copy(query, answer):
        return "copied_question"
    if refusals.score(answer) > refusals.refused_at:
        return "refusal"
    if query and other_language(languages, query, answer):
        return "other_language"
    if endings.likelihood(answer) < endings.break_at:
        return "truncated"
    return None


def flag(answers: DataFrame, documents: DataFrame, key: str = "answer_id", query: str = "query", answer: str = "answer") -> DataFrame:
    """answer_id, defect (null for a sound pair) of every row."""
    models = answers.sparkSession.sparkContext.broadcast((fit_languages(documents), *fit_responses(answers, key, answer)))  # fixed-size tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [defect(*models.value, q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["answer_id", "defect"])

    return answers.select(F.col(key).cast("bigint").alias("answer_id"), F.col(query).alias("q"), F.col(answer).alias("a")).mapInArrow(run, "answer_id bigint, defect string")


def found(answers: DataFrame, documents: DataFrame) -> DataFrame:
    return flag(answers, documents).filter("defect IS NOT NULL")
