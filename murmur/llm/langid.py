"""Languages of documents and of the parts of mixed ones, by cross-parsing against labelled text.

Labelled text of every language (a bounded sample, at most TRAIN_DOCS documents and TRAIN_CHARS characters a language) is
turned into a suffix automaton. A sentence is parsed greedily into the longest pieces that occur in that text: the language
that needs the fewest pieces per character wins, and how far the next one is behind gives the confidence. Labels
are known to be partly wrong, so sentences that letter trigrams of the whole sample ascribe to another language are left out of
the labelled text first. All sentences of all documents are classified, whatever their labels.

A batch's sentences run through the automata in step, one character of all of them at a time, in numpy.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "ja")
#: Bounds of the labelled sample, a language.
TRAIN_DOCS, TRAIN_CHARS = 400, 20_000
#: Cells of the hashed trigrams.
CELLS = 1 << 18
#: Columns of an automaton's table: the most frequent characters of its text; edges by all others are in a sorted list. Symbol 0 is
#: a character that the text does not hold.
COLUMNS = 64
#: Sentences, and characters of their table, that are parsed in step.
ROWS, CELLS_AT_ONCE = 16_384, 4_000_000
#: A sentence has at least so many letters (or so many of a script without spaces) and so many words.
LETTERS, DENSE_LETTERS, WORDS = 10, 5, 3
#: Characters of a stretch that is parsed at once, documents whose sentences are parsed together.
STRETCH, AT_ONCE = 2000, 4000
#: A sentence with more pieces a character is in none of the languages (nor is it parsed by those that lack so many of its characters); one must be this much ahead to count beside the main language.
MOST_PIECES, AHEAD = 0.5, 0.2

#: Spellings of the languages in labels: codes of three letters and names (fixed values).
SPELLINGS = {
    "en": "en eng english anglais englisch inglés inglese inglês engels английский 英語",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão duits немецкий ドイツ語",
    "fr": "fr fra fre french français francais französisch francés francese francês frans французский フランス語",
    "es": "es spa spanish español espanol castellano espagnol spanisch spagnolo espanhol spaans испанский スペイン語",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese portugees португальский ポルトガル語",
    "it": "it ita italian italiano italien italienisch italiaans итальянский イタリア語",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch neerlandés olandese holandês нидерландский オランダ語",
    "ru": "ru rus russian русский russe russisch ruso russo ロシア語",
    "ja": "ja jpn japanese 日本語 nihongo japonais japanisch japonés giapponese japonês japans японский",
}


def canonical(label: Column) -> Column:
    """The language a label names in any spelling (case, region, three letters, a name), null if none of LANGUAGES."""
    known = F.create_map(*[F.lit(x) for lang, names in SPELLINGS.items() for name in names.split() for x in (name, lang)])
    text = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    return F.coalesce(known[text], known[F.regexp_extract(text, r"^([^\s\-_]+)[\-_].*$", 1)])


@lru_cache(maxsize=1)
def _patterns():
    """What is taken out where a text holds one of some strings, sentence ends, apostrophes outside words, what parts words, numbers,
    dense scripts, and texts without combining marks, for which the first of the two word patterns does."""
    import re

    import regex

    noise = [
        (("`", "<"), " ", re.compile(r"```.*?```|`[^`\n]*`|<[^>\n]*>", re.S)),
        (("&",), " ", re.compile(r"&#?\w+;")),
        (("://", "www."), " ", re.compile(r"(?:https?://|www\.)\S+")),
        (("@", "#"), " ", regex.compile(r"[^\s@]+@[^\s@]+\.\w+|[@#][\p{L}\p{N}_.\-]+")),
        (("\u200b", "\ufeff", "\u00ad"), "", re.compile("[\u200b\ufeff\u00ad]")),
    ]
    end = re.compile(r"""[.!?…。！？]['"»”’)」』]*\s+|[。！？]['"»”’)」』]*|[«»„“”「」]""")
    plain = re.compile("[\x00-\u02ff\u0370-\u0482\u048a-\u058f\u1e00-\u20cf\u2100-\u2cee\u3000-\u3029\u3030-\u3098\u309b-\ua66e\uac00-\ud7ff\uff00-\uffff]*")
    gap = (re.compile(r"(?:[^\w'\n]|_)+"), regex.compile(r"[^\p{L}\p{M}\p{N}'\n]+"))
    loose = (re.compile(r"(?<![^\W\d_])'|'(?![^\W\d_])"), regex.compile(r"(?<!\p{L})'|'(?!\p{L})"))
    number = (re.compile(r"\d+"), regex.compile(r"\p{N}+"))
    return noise, end, loose, gap, number, regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"), plain


def sentences(text: str | None) -> list[tuple[str, bool]]:
    """(sentence, whole) in order, normalised to lower-case words parted by single spaces; numbers are one symbol.

    Tags, links, handles, entities and code are taken out first. ``whole`` tells sentences from fragments, which are too short.
    """
    if not text:
        return []
    noise, end, loose, gap, number, dense, plain_text = _patterns()
    ascii_ = text.isascii()
    if not ascii_ and max(text) >= "\uff00":  # letters in bold, script or full width are plain ones
        text = unicodedata.normalize("NFKC", text)
    for marks, instead, pattern in noise:
        if any(m in text for m in marks):
            text = pattern.sub(instead, text)
    text = end.sub("\n", text.lower())
    way = 0 if ascii_ or plain_text.fullmatch(text) else 1
    if "'" in text:
        text = loose[way].sub(" ", text)
    text = number[0 if ascii_ else 1].sub("0", gap[way].sub(" ", text))
    out = []
    for plain in text.split("\n"):
        plain = plain.strip()
        words = plain.count(" ") + 1
        letters = len(plain) - words + 1 - plain.count("0") - plain.count("'")
        if letters > 0:
            packed = 0 if plain.isascii() else len(dense.findall(plain)) if max(plain) > "\u2e7f" else 0
            whole = packed >= DENSE_LETTERS or (letters >= LETTERS and words >= WORDS and words - plain.split(" ").count("0") >= WORDS)
            out.append((plain, whole))
    return out


class Automaton:
    """The suffix automaton of a text: a step leads from a state by a symbol to a state, or to 0 where a piece ends; 0 is also the start."""

    def __init__(self, text: str):
        common = [c for c, _ in Counter(text).most_common()]
        symbols = {c: i + 1 for i, c in enumerate(common)}
        self.code = np.zeros(0x110000, np.uint16 if len(common) < 0xFFFF else np.uint32)  # all of Unicode
        self.code[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            c = symbols[ch]
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        kind = np.uint16 if len(nxt) < 1 << 16 else np.uint32  # small tables stay in the caches
        self.table = np.zeros((len(nxt), COLUMNS), kind)
        rare: list[tuple[int, int]] = []
        for s, row in enumerate(nxt):
            for c, t in row.items():
                if c < COLUMNS:
                    self.table[s, c] = t
                else:
                    rare.append((s << 32 | c, t))
        rare.sort()
        self.edges, self.ends = np.array([e for e, _ in rare], np.int64), np.array([t for _, t in rare], np.int64)
        self.start = np.zeros(len(common) + 1, np.int64)
        for c, t in nxt[0].items():
            self.start[c] = t

    def pieces(self, symbols: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Pieces of each row of symbols; at each place only the first ``active`` rows go on."""
        flat, start, wide = self.table.ravel(), self.start, len(self.edges) > 0
        state, count = np.zeros(len(symbols), np.int64), np.ones(len(symbols))
        columns = np.ascontiguousarray(symbols.T)  # a place of all rows lies together
        for t in range(symbols.shape[1]):
            m = active[t]
            c = columns[t, :m].astype(np.int64)
            rare = np.flatnonzero(c >= COLUMNS) if wide else c[:0]
            if len(rare):
                near = c.copy()
                near[rare] = 0
                new = flat.take(state[:m] * COLUMNS + near).astype(np.int64)
                edge = state[rare] << 32 | c[rare]
                at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                new[rare] = np.where(self.edges[at] == edge, self.ends[at], 0)
            else:
                new = flat.take(state[:m] * COLUMNS + c).astype(np.int64)
            over = np.flatnonzero(new == 0)
            count[over] += 1
            new[over] = start[c[over]]
            state[:m] = new
        return count


class Parser:
    """The automata of all languages."""

    def __init__(self, texts: dict[str, str]):
        self.languages = [lang for lang in LANGUAGES if texts.get(lang)]
        self.automata = [Automaton(texts[lang]) for lang in self.languages]

    def pieces(self, parts: list[str]) -> np.ndarray:
        """Pieces per character of each sentence by each language; very long ones are parsed in stretches and added up.

        Where a language's text lacks more than MOST_PIECES of a sentence's characters, which are pieces of their own, that share
        stands for its number of pieces: it is no candidate.
        """
        stretches = [(k, p[a : a + STRETCH]) for k, p in enumerate(parts) for a in range(0, max(1, len(p)), STRETCH)]
        owner = np.array([k for k, _ in stretches])
        sizes = np.maximum(1, np.array([len(p) for p in parts]))
        out = np.zeros((len(parts), len(self.languages)))
        rows = [p for _, p in stretches]
        for place in self._together(rows):
            lengths = np.array([len(rows[r]) for r in place])
            longest = max(1, int(lengths[0]))
            points = np.zeros((len(place), longest), np.uint32)
            inside = np.arange(longest) < lengths[:, None]
            points[inside] = np.frombuffer("".join(rows[r] for r in place).encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.minimum(points, 0x10FFFF)
            for k, a in enumerate(self.automata):
                symbols = a.code[points]
                strange = ((symbols == 0) & inside).sum(1)
                asked = np.flatnonzero(strange <= MOST_PIECES * lengths)
                count = strange + 1.0
                if len(asked):
                    active = np.searchsorted(-lengths[asked], -np.arange(int(lengths[asked[0]])), side="left")  # rows longer than each place
                    count[asked] = a.pieces(symbols[asked, : lengths[asked[0]]] if len(asked) < len(place) else symbols, active)
                np.add.at(out[:, k], owner[place], count)
        return out / sizes[:, None]

    @staticmethod
    def _together(rows: list[str]) -> Iterator[np.ndarray]:
        """Rows of about one length, the longest first."""
        lengths = np.array([len(r) for r in rows])
        order = np.argsort(-lengths, kind="stable")
        a = 0
        while a < len(order):
            b = a + max(1, min(ROWS, CELLS_AT_ONCE // max(1, int(lengths[order[a]]))))
            yield order[a:b]
            a = b


@lru_cache(maxsize=2)
def _parser(key: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(key))


def _trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, starts): the hashed letter trigrams of each sentence, spaces at its ends included, as a flat array."""
    points = np.frombuffer("".join(f" {p} " for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(p) + 2 for p in parts])
    h = ((points[:-2] * np.uint64(1_000_003) + points[1:-1]) * np.uint64(1_000_003) + points[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18)
    inside = np.arange(len(h)) + 2 < np.repeat(ends, np.diff(np.r_[0, ends]))[: len(h)]
    sizes = np.array([len(p) for p in parts])
    return h[inside].astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]]


def labelled_text(rows: list[tuple[str, str, bool]]) -> dict[str, str]:
    """Text of each language from (label, text, checked) rows, checked ones first, without sentences that are ascribed elsewhere.

    Letter trigrams of all sentences, counted by label, decide; two rounds.
    """
    lines = [(label, s) for label, text, _ in sorted(rows, key=lambda r: not r[2]) for s, whole in sentences(text) if whole]
    if not lines:
        return {}
    known = sorted({label for label, _ in lines})
    given = np.array([known.index(label) for label, _ in lines])
    grams, starts = _trigrams([s for _, s in lines])
    of = np.repeat(np.arange(len(lines)), np.diff(np.r_[starts, len(grams)]))
    labels = given
    for _ in range(2):
        counts = np.bincount(labels[of] * CELLS + grams, minlength=len(known) * CELLS).reshape(len(known), CELLS)
        score = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 1e4))
        labels = np.stack([np.add.reduceat(row[grams], starts) for row in score]).argmax(0)
    out: dict[str, list[str]] = defaultdict(list)
    size: Counter = Counter()
    seen = set()
    for (label, s), same in zip(lines, given == labels):
        found = label
        if same and s not in seen and size[found] + len(s) < TRAIN_CHARS:
            seen.add(s)
            out[found].append(s)
            size[found] += len(s) + 1
    return {x: "\n".join(v) for x, v in out.items()}


def train(documents: DataFrame, key: str, text: str, label: str, checked: DataFrame | None = None, checked_label: str = "checked_lang", mixed: str = "is_mixed") -> dict[str, str]:
    """Labelled text for ``classify``: at most TRAIN_DOCS documents a language by hash of key, checked ones first."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("x"), canonical(F.col(label)).alias("l"))
    if checked is not None:
        sure = checked.where(F.coalesce(F.col(mixed), F.lit(1)) == 0).select(F.col(key).alias("k"), canonical(F.col(checked_label)).alias("c")).dropDuplicates(["k"])
        rows = rows.join(sure, "k", "left").withColumn("l", F.coalesce("c", "l")).withColumn("sure", F.col("c").isNotNull())
    else:
        rows = rows.withColumn("sure", F.lit(False))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("sure"), F.xxhash64("k"), "k"))
    picked = rows.where("l IS NOT NULL AND length(x) > 0").withColumn("r", place).where(F.col("r") <= TRAIN_DOCS)
    return labelled_text([(r["l"], r["x"], r["sure"]) for r in picked.orderBy("l", "r").collect()])


def judge(parser: Parser, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, lead, pieces) of sentences: the lead is how much fewer pieces the best needs than the next."""
    p = parser.pieces(parts)
    if p.shape[1] == 1:
        return np.zeros(len(p), int), np.ones(len(p)), p[:, 0]
    order = np.argsort(p, axis=1, kind="stable")
    best, second = p[np.arange(len(p)), order[:, 0]], p[np.arange(len(p)), order[:, 1]]
    return order[:, 0], 1 - best / second, best


def segments(texts: list[str | None], parser: Parser) -> list[list[tuple[str, int, int, float]]]:
    """For each text its (language, sentences, characters, confidence) segments in order: runs of sentences of one language.

    Sentences that no language explains, or that are not clear enough to stand against the text's main language, take
    the main language's side. A text without a whole sentence is judged as one from its fragments, if they suffice.
    """
    owner: list[int] = []
    parts: list[str] = []
    for i, text in enumerate(texts):
        found = sentences(text)
        whole = [s for s, w in found if w]
        if not whole and found:
            joined = " ".join(s for s, _ in found)
            whole = [joined] if len(joined.replace(" ", "").replace("0", "")) >= LETTERS and joined.count(" ") + 1 >= WORDS else []
        for s in whole:
            owner.append(i)
            parts.append(s)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not parts or not parser.languages:
        return out
    lang, lead, pieces = judge(parser, parts)
    by: dict[int, list[int]] = defaultdict(list)
    for k, i in enumerate(owner):
        if pieces[k] <= MOST_PIECES:
            by[i].append(k)
    for i, ks in by.items():
        votes: Counter = Counter()
        for k in ks:
            votes[lang[k]] += len(parts[k]) * float(lead[k])
        main = max(votes, key=lambda x: (votes[x], -x))
        run: list[tuple[int, int]] = [(int(lang[k]) if lead[k] >= AHEAD else int(main), k) for k in ks]
        a = 0
        while a < len(run):
            b = a
            while b < len(run) and run[b][0] == run[a][0]:
                b += 1
            inside = [k for _, k in run[a:b]]
            chars = sum(len(parts[k]) for k in inside)
            sure = sum(len(parts[k]) * float(lead[k]) for k in inside) / chars
            out[i].append((parser.languages[run[a][0]], b - a, chars, round(sure, 4)))
            a = b
    return out


def classify(documents: DataFrame, key: str, text: str, label: str, trained: dict[str, str]) -> DataFrame:
    """(key, label, segment, lang, sentences, chars, confidence): every document's segments in order, from 1.

    ``label``: the language the given label names, or null. Documents that hold no language (null, empty or blank texts,
    numbers, links, code) have no rows. Columns beside those named play no part.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(sorted(trained.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            for s in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(s, AT_ONCE)
                rows, flat = [], []
                for i, found in enumerate(segments(part.column(2).to_pylist(), parser)):
                    for n, seg in enumerate(found):
                        rows.append(i)
                        flat.append((n + 1, *seg))
                at = pa.array(rows, pa.int64())
                columns = list(zip(*flat)) or [[]] * 5
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["k", "l", "segment", "lang", "sentences", "chars", "confidence"])

    rows = documents.select(F.col(key).alias("k"), canonical(F.col(label)).alias("l"), F.col(text).alias("x"))
    out = rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, l string, segment int, lang string, sentences int, chars int, confidence double")
    return out.select(F.col("k").alias(key), F.col("l").alias("label"), "segment", "lang", "sentences", "chars", "confidence")


def held_languages(found: DataFrame, key: str) -> DataFrame:
    """(key, label, lang, share, confidence): one row for each language a document holds, with its share of the characters."""
    per = found.groupBy(key, "label", "lang").agg(F.sum("chars").alias("n"), F.sum(F.col("confidence") * F.col("chars")).alias("c"))
    total = F.sum("n").over(Window.partitionBy(key))
    return per.select(key, "label", "lang", F.round(F.col("n") / total, 4).alias("share"), F.round(F.col("c") / F.col("n"), 4).alias("confidence"))


def wrong_labels(found: DataFrame, key: str) -> DataFrame:
    """(key, lang): documents whose label is missing or names another language than the one held, and all that hold several."""
    held = found.groupBy(key).agg(F.first("label").alias("label"), F.collect_set("lang").alias("langs"))  # at most the known languages
    listed = held.where((F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.get("langs", F.lit(0))))
    return listed.select(key, F.explode("langs").alias("lang"))
