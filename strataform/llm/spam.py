"""Pages of keywords, links or tags instead of sentences.

A text is cut into blocks (paragraphs; short ones that follow each other count
together).  Each block is measured by the signs below; a page is spam if blocks
that are neither sentences nor data hold the greater part of it.

* top-word and n-gram shares: one word, pair or triple comes again and again;
* duplicate-line share: the same line comes again;
* link-text ratio: words inside links, bare or obfuscated addresses;
* separator density: words strung together by bars, commas, arrows, or by
  nothing (``GardenHoseSale``, ``#a #b``, ``[a][b]``, ``brand:x``);
* missing function words: sentences need articles, prepositions, auxiliaries;
* sentence ends: prose has them at a steady rate, keywords too few or too many.

No limit is a number of its own.  Quartiles of every sign are taken per
language over the blocks of all documents; each sign counts by its distance
from the median in robust deviations, wider for shorter blocks, and the sum of
the distances decides.  Medians, and the quartile on the side away from spam,
stay those of sentences while less than half of the blocks is spam.  Rows with times,
dates or amounts are data, not keywords, and never count against a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.workspace import spread, staged

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for from with about into before after until while because so that which who it its is are was were be been has have had not no do does did will would can could must may if when as than then this these those there their they we our you your he she his her i one only still up down off out nobody",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von zu im in am an auf bei für mit nach aus vor über unter bis weil da damit dass wer was wie wo es ist sind war waren wird wurde wurden werden hat haben hatte nicht kein keine noch schon nur sich wir ihr sie er ich man als wenn so auch zum zur ihre alle niemand",
    "fr": "le la les l un une des du de d et ou mais à au aux en dans sur par pour avec sans sous avant après car que qu qui quoi ne n pas plus ce cet cette ces il elle ils elles on nous vous je se s son sa ses leur leurs est sont était a ont été être avoir doit afin bien si comme encore y",
    "es": "el la los las un una unos unas de del y o pero a al en por para con sin sobre ante tras desde hasta porque que quien no ni se su sus lo le les es son era fue ha han había hay está están ser debe más ya si como aún todo toda nadie antes después nos me te",
}
LANGUAGES = (*FUNCTION_WORDS, "ja")
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Particles and endings without which no Japanese sentence is made.
JA_MARKS = re.compile(r"[はがをにのでともへ]|から|まで|です|ます|した|ません|ない|ある|いる|する")
_KANA_KANJI = re.compile(r"[぀-ヿ㐀-鿿豈-﫿々ー]")
_KANA_RUN = re.compile(r"[ァ-ヶー]+|[㐀-鿿々]+|[ぁ-ゖ]+")

_WORD = re.compile(r"\w+")
#: Links: what must stand in a text for the rule to be tried, and the rule; a group holds the words shown.
_LINKS = [
    ("<a", re.compile(r"<a\b[^>]*>(.*?)(?:</a>|$)", re.I)),
    ("](", re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")),
    ("[[", re.compile(r"\[\[([^\[\]\n]*)\]\]")),
    ("[http", re.compile(r"\[https?://\S+ ([^\[\]\n]*)\]")),
]
_DOMAINS = ("com", "net", "org", "info", "biz", "shop", "invalid", "test", "example")
_ADDRESS_HINTS = (*(f".{d}" for d in _DOMAINS), "[.]", " dot ", "://", "**p", "[:]", "www")
_URL = re.compile(
    r"\bh(?:tt|\*\*|xx)ps?(?:://|\[:\]//)[^\s<>\"')\]]+(?:\[\.\][^\s<>\"')]+)?|\bwww\d?(?:\.|\[\.\])[\w.\[\]-]+(?:/\S*)?"
    rf"|(?<![\w-])[\w-]++(?:\.|\[\.\]| dot )(?:{'|'.join(_DOMAINS)})\b(?:/\S*)?",
    re.I,
)
_TAGS = re.compile(r"<[^<>]{0,400}>")
_DIGIT = re.compile(r"[\d€$£¥]")
_DATA = re.compile(
    r"(?=[\d€$£¥])(?:\b\d{1,2}:\d\d\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}(?:[./]\d{0,4})?(?!\d)|\b\d+[.,]\d\d\b|[€$£¥]\s?\d|\d\s?[€$£¥]|\d{1,2}月\d{1,2}日|\d{1,2}時|\d+円)"
)
_HASHTAG = re.compile(r"(?:^|\s)#\w{2,}")
_LABEL = re.compile(r"[a-z]{2,10}[:=]\S")
_JOINED = re.compile(r"[a-zäöüéßíñ0-9][A-ZÄÖÜÉ]")
_CAMEL = re.compile(r"\b(?:[A-ZÄÖÜÉ0-9][\wäöüéß]*?[a-zäöüéßíñ0-9](?=[A-ZÄÖÜÉ]))+\w")
_BRACKETS = re.compile(r"\[[^\[\]\n]{1,60}\](?!\()")
_SEPARATORS = "|,;>/·•»→~=+*[]#:‐–—-"
_SENTENCE_END = re.compile(r"[.!?。！？](?:(?<=[。！？])|(?=[\s\"'»”’)]|$))")
_PARTING = re.compile(r"\n\s*\n")
_BARE = re.compile(r"\W+|\d+")

#: Words of a block from which on its words are judged, and of a block that is taken into the quartiles.
SHORT, USUAL = 8, 15
#: A row is data if it has no more words than this for each time, date or amount.
WORDS_PER_FIGURE = 12
#: Least characters of a page's link blocks together; less is a link in passing.
LISTED = 30


def language(words: list[str], text: str) -> str:
    """The language of which most function words occur; by script for Japanese."""
    if not text.isascii() and _KANA_KANJI.search(text) and len(_KANA_KANJI.findall(text)) > 0.2 * (sum(map(len, words)) or 1):
        return "ja"
    have = set(words)
    hits = {k: len(s & have) for k, s in _SETS.items()}
    most = max(hits.values())
    if not most:
        return "en"
    best = [k for k, n in hits.items() if n == most]
    return best[0] if len(best) == 1 else max(best, key=lambda k: (sum(w in _SETS[k] for w in words), k == "en"))


def blocks_of(text: str) -> list[list[str]]:
    """Lines of each block: blank lines part blocks, but short paragraphs without a sentence end go together."""
    out: list[list[str]] = []
    open_ = False
    for paragraph in _PARTING.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        lines = [x for x in paragraph.split("\n") if x and not x.isspace()]
        if not lines:
            continue
        short = len(lines) == 1 and len(lines[0]) < 120 and lines[0].count(" ") < SHORT and not _SENTENCE_END.search(lines[0])
        if short and open_:
            out[-1] += lines
        else:
            out.append(lines)
        open_ = short
    return out


class _Shown:
    """A block without link targets and tags, and its words."""

    __slots__ = ("lines", "raw", "text", "words", "linked", "bare")

    def __init__(self, lines: list[str], addresses: bool):
        self.lines, self.raw, self.linked, self.bare = lines, "\n".join(lines), 0, 0
        text = self.raw
        low = text.lower()
        for hint, rule in _LINKS:
            if hint in low:
                self.linked += sum(len(_WORD.findall(m.group(1))) + 1 for m in rule.finditer(text))
                text = rule.sub(r" \1 ", text)
                low = text.lower()
        if addresses and any(h in low for h in _ADDRESS_HINTS):
            self.bare = len(_URL.findall(text))
            text = _URL.sub(" ", _TAGS.sub(" ", text) if "<" in text else text)
            low = text.lower()
        elif "<" in text:
            text = _TAGS.sub(" ", text)
            low = text.lower()
        self.text, self.words = text, _WORD.findall(low)


#: Order of the measures of a block.
MEASURES = ("chars", "words", "lines", "function", "top_word", "top_gram", "duplicate", "links", "separators", "glued", "data", "ends")
_INTS = ("chars", "words", "lines")


def measure(block: _Shown, lang: str) -> tuple:
    """The measures of a block; shares are of its words, repetitions are counted beyond the first."""
    words, text, lines = block.words, block.text, block.lines
    stop = _SETS.get(lang, frozenset())
    if lang == "ja":  # words are runs of one script
        words = [x for w in words for x in (_KANA_RUN.findall(w) or [w])]
        function = len(JA_MARKS.findall(text)) / (max(1, len(_KANA_KANJI.findall(text))) + 2.0 * sum(w.isascii() for w in words))
    n = len(words)
    counts = Counter(words)
    if lang != "ja":
        function = sum([counts[w] for w in stop & counts.keys()]) / n if n else 0.0
    top_word = top_pair = top_triple = 1
    for w, c in counts.items():
        if c > top_word and w not in stop and (lang == "ja" or len(w) > 1):
            top_word = c
    for (a, b), c in Counter(zip(words, words[1:])).items():
        if c > top_pair and not (a in stop and b in stop):
            top_pair = c
    if top_pair > 1:
        top_triple = max(Counter(zip(words, words[1:], words[2:])).values(), default=1)
    tokens = text.split()
    glued = 0
    if _JOINED.search(text):
        glued += sum(1 for t in tokens if _JOINED.search(t) and _CAMEL.search(t))
    if "#" in text:
        glued += len(_HASHTAG.findall(text))
    if ":" in text or "=" in text:
        glued += sum(1 for t in tokens if (":" in t or "=" in t) and _LABEL.match(t))
    if "[" in text:
        glued += len(_BRACKETS.findall(text))
    duplicate = 1 - len({_BARE.sub(" ", x).strip().lower() for x in lines}) / len(lines) if len(lines) >= SHORT else 0.0
    data = 0.0
    if _DIGIT.search(text):
        sizes = [x.count(" ") + 1 for x in lines]
        figures = [len(_DATA.findall(x)) if _DIGIT.search(x) else 0 for x in lines]
        data = sum(k for k, f in zip(sizes, figures) if f * WORDS_PER_FIGURE >= k) / sum(sizes)
    share = 1 / n if n else 0.0
    return (
        sum(map(len, block.raw.split())),
        n,
        len(lines),
        float(function),
        (top_word - 1) * share,
        (max(top_pair, top_triple) - 1) * share,
        duplicate,
        (block.linked + 2 * block.bare) / (n + 2 * block.bare) if n + block.bare else 0.0,
        sum(map(text.count, _SEPARATORS)) * share,
        glued / len(tokens) if tokens else 0.0,
        data,
        len(_SENTENCE_END.findall(text)) * share,
    )


def page(text: str) -> tuple[str, list[tuple]]:
    """Language and measured blocks of a text."""
    low = text.lower()
    addresses = any(h in low for h in _ADDRESS_HINTS)
    blocks = [_Shown(lines, addresses) for lines in blocks_of(text)]
    lang = language([w for b in blocks for w in b.words], text)
    return lang, [measure(b, lang) for b in blocks]


MEASURED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField(m, T.IntegerType() if m in _INTS else T.DoubleType()) for m in MEASURES]))),
    ]
)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32() if m in _INTS else pa.float64() for m in MEASURES]
    for batch in batches:
        langs, offsets, rows = [], [0], []
        for text in batch.column(1).to_pylist():
            lang, blocks = page(text)
            langs.append(lang)
            rows += blocks
            offsets.append(len(rows))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
        blocks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(MEASURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), blocks], names=MEASURED.names)


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, language, blocks`` of every text that isn't null; row by row."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return spread(texts).mapInArrow(_measure_batches, MEASURED)


#: Signs that are measured against a language's quartiles: which way counts (1 more, -1 less, 0 either), weight, and the greatest
#: distance that counts.  No sign but missing function words and repetition can reach ``SCORE`` alone.
SIGNS = {"function": (-1, 1.0, 10.0), "top_word": (1, 0.5, 20.0), "top_gram": (1, 0.5, 20.0), "ends": (0, 0.5, 6.0), "separators": (1, 1 / 6, 12.0)}
#: Shares that are what they are in any language: words in tags or run together, lines that repeat others.
PLAIN = {"glued": 12.0, "duplicate": 6.0}
SCORE = 6.0


def calibrated(pages: DataFrame) -> DataFrame:
    """``language, words, <sign>, <sign>_spread``: median and robust deviation of every sign.

    The deviation is that of the half on which no spam lies.  One pass with partial sketches over the longer blocks of all documents, so
    a frequent language is no hot group; at most one row per known language.
    """
    blocks = pages.select("language", F.explode("blocks").alias("b")).where(F.col("b.words") >= USUAL)
    quartiles = {m: F.percentile_approx(F.col(f"b.{m}"), [0.25, 0.5, 0.75], 10_000) for m in ("words", *SIGNS)}
    found = blocks.groupBy("language").agg(*[q.alias(m) for m, q in quartiles.items()])

    def deviation(m: str) -> Column:
        q = F.col(m)
        below, above = (q[1] - q[0]) / 0.6745, (q[2] - q[1]) / 0.6745
        sober = {1: below, -1: above, 0: F.least(below, above)}[SIGNS[m][0]]
        return F.greatest(sober, 0.1 * q[1])

    return found.select("language", F.col("words")[1].alias("words"), *[F.col(m)[1].alias(m) for m in SIGNS], *[deviation(m).alias(f"{m}_spread") for m in SIGNS])


def _distance(b: Column, usual: Column, sign: str) -> Column:
    """How far a block lies from the usual, in deviations; 0 where a sign never varies."""
    # fewer words make a share less certain
    width = F.greatest(F.lit(1.0), F.sqrt(usual["words"] / F.greatest(F.lit(1), b["words"])))
    return F.coalesce(F.try_divide(b[sign] - usual[sign], usual[f"{sign}_spread"] * width), F.lit(0.0))


def _score(b: Column, usual: Column) -> Column:
    total = F.lit(0.0)
    repeated = []
    for sign, (way, weight, most) in SIGNS.items():
        far = _distance(b, usual, sign)
        part = weight * F.least(F.greatest(F.abs(far) if way == 0 else way * far, F.lit(0.0)), F.lit(most))
        if sign.startswith("top_"):
            repeated.append(part)  # a repeated n-gram repeats its words: the clearer of the two counts
        else:
            total = total + part
    total = total + F.greatest(*repeated)
    for sign, weight in PLAIN.items():
        total = total + weight * F.least(b[sign], F.lit(0.5))
    return total


def _linklike(b: Column, usual: Column) -> Column:
    """Whether a block is links or menu entries instead of sentences."""
    return (b["links"] >= 0.5) & (b["function"] < F.coalesce(0.75 * usual["function"], F.lit(0.3)))


def _junk(b: Column, usual: Column, listed: Column) -> Column:
    """Whether a block is neither sentences nor data; ``listed`` has the characters of the page's link blocks."""
    data = (b["data"] >= 0.5) & (b["links"] < 0.3)
    # entries of a list of links may be parted by blank lines or captions, so all of the page's count together
    return ~data & ((_linklike(b, usual) & (listed >= LISTED)) | ((b["words"] >= SHORT) & (_score(b, usual) > SCORE)))


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id, language, junk_share``: the part of each text that is keywords, links or tags.

    The share counts characters other than blanks.  It is 0 for blank texts
    and for one unbroken run; null texts have no row.  A repeated row comes out
    again.  A language without a longer block has nothing to compare with and
    takes the median of the other languages; where no language has one, only
    links, joined words and repeated lines tell.
    """
    spark = documents.sparkSession
    pages = staged(measured(documents), "spam-pages")
    usual = calibrated(pages)
    columns = [c for c in usual.columns if c != "language"]
    held = {r["language"]: [r[c] for c in columns] for r in usual.collect()}  # at most one row per known language
    middle = [float(median(x)) for x in zip(*held.values())]
    filled = [(lang, *(float(x) for x in held.get(lang, middle))) for lang in LANGUAGES] if held else []
    known = spark.createDataFrame(filled, T.StructType([T.StructField("language", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in columns)]))
    rows = pages.join(F.broadcast(known.select("language", F.struct(*columns).alias("usual"))), "language", "left")
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda a, b: a + b["chars"])
    u = F.col("usual")
    rows = rows.withColumn("listed", chars(F.filter("blocks", lambda b: _linklike(b, u))))
    junk = chars(F.filter("blocks", lambda b: _junk(b, u, F.col("listed"))))
    return rows.select("doc_id", "language", F.coalesce(F.try_divide(junk, chars(F.col("blocks"))), F.lit(0.0)).alias("junk_share"))


def spam_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose greater part is keywords, links or tags."""
    return judged(documents).where("junk_share > 0.5").select("doc_id").distinct()
