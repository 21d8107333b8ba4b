"""Keyword statistics, rankings, filters and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import keyword_tokens

#: Terms in fewer items are not ranked; at most so many are.
MIN_DOCS, MAX_TERMS = 50, 100_000


def keyword_stats(items: DataFrame, text: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """term, doc_count and occurrences over one text column, for each value of the columns ``by``. Terms of one character or of ASCII digits do not count.

    An item's distinct terms and its occurrences are lists of one row set, so the one shuffle
    holds partial sums by term and no item ids.
    """
    every = items.select(*by, keyword_tokens(F.col(text)).alias("every")).select(*by, "every", F.array_distinct("every").alias("own"))

    def part(docs: int, said: int, terms: str) -> Column:
        return F.struct(F.lit(docs).alias("docs"), F.lit(said).alias("said"), F.col(terms).alias("terms"))

    # Where no term repeats, one list is both.
    parts = F.when(F.size("every") == F.size("own"), F.array(part(1, 1, "every"))).otherwise(F.array(part(1, 0, "own"), part(0, 1, "every")))
    rows = every.select(*by, F.explode(parts).alias("p")).select(*by, "p.docs", "p.said", F.explode("p.terms").alias("term"))
    return rows.groupBy(*by, "term").agg(F.sum("docs").alias("doc_count"), F.sum("said").alias("occurrences"))


def merged(*stats: DataFrame) -> DataFrame:
    """Statistics of disjoint sets of items, added up; negative ones take items away again."""
    every = stats[0]
    for s in stats[1:]:
        every = every.unionByName(s)
    return every.groupBy("term").agg(F.sum("doc_count").alias("doc_count"), F.sum("occurrences").alias("occurrences")).where("doc_count > 0")


def without(stats: DataFrame, filtered: DataFrame) -> DataFrame:
    """Statistics of terms that no filter row names."""
    return stats.join(filtered.select("term").distinct(), "term", "left_anti")


def top_keywords(stats: DataFrame, filtered: DataFrame | None = None, min_docs: int = MIN_DOCS, limit: int | None = None) -> DataFrame:
    """Terms in at least ``min_docs`` items, most frequent first (ties by occurrences, then the term)."""
    kept = stats.where(F.col("doc_count") >= min_docs)
    kept = kept if filtered is None else without(kept, filtered)
    most = MAX_TERMS if limit is None else max(1, min(limit, MAX_TERMS))
    return kept.orderBy(F.desc("doc_count"), F.desc("occurrences"), F.asc("term")).limit(most)


def ranked(stats: DataFrame, filtered: DataFrame | None = None, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """term and rank (from 0), with ``counts`` also doc_count and occurrences, of every term in at least ``min_docs`` items, in the order of ``top_keywords`` and without its bound.

    Terms are numbered within buckets that follow the order (equal counts, first two characters), and a bucket's
    terms come after those of the buckets before it: only the buckets are numbered in one task.
    """
    kept = stats.where(F.col("doc_count") >= min_docs)
    kept = kept if filtered is None else without(kept, filtered)
    kept = kept.withColumn("head", F.substring("term", 1, 2))
    bucket = ["doc_count", "occurrences", "head"]
    order = Window.orderBy(F.desc("doc_count"), F.desc("occurrences"), F.asc("head"))
    ahead = kept.groupBy(*bucket).agg(F.count("*").alias("n")).select(*bucket, (F.sum("n").over(order) - F.col("n")).alias("ahead"))
    rows = kept.withColumn("place", F.row_number().over(Window.partitionBy(*bucket).orderBy("term")))
    return rows.join(ahead, bucket).select("term", (F.col("ahead") + F.col("place") - 1).alias("rank"), *(["doc_count", "occurrences"] if counts else []))


# Terms that tell nothing about an item, by kind. Order of kinds is the order of the test.
FILE_FORMATS = """
mp4 mkv avi mov wmv flv webm m4v mpg mpeg m2ts mts ogv ogm rmvb vob ts mka mks mk3d mp3 flac wav aac ac3 dts ogg oga opus wma
m4a ape tak tta mp2 pdf epub mobi azw azw3 azw4 txt doc docx docm rtf ppt pptx pps xls xlsx xlsm csv zip rar 7z tar gz bz2 xz
lz4 zst tgz tbz iso img bin cue mds mdf nrg cdi ccd apk exe dmg pkg msi deb rpm jar whl dll sys drv nfo srt sub ass idx smi
ssa usf vtt jpg jpeg png gif bmp tif tiff webp torrent part blu bluray
""".split()
RESOLUTION = r"^(\d{3,4}x\d{3,4}p?|\d{3,4}p|hd\d{3,4}p?|fullhd|2k|4k|8k|uhd|qhd|fhd|hd|sd)$"
CODECS = """
x264 x265 h264 h265 hevc av1 avc vc1 vp9 10bit 8bit 24bit 16bit 60fps 120fps hdr hdr10 hdr10plus hdrplus dolby atmos truehd
dtshd eac3 dd ddp ddp5 dd5 dd2 remux bdrip webrip webdl web-dl brrip hdrip hdtv hdtvrip dvrip dvdrip dvdscr cam scr r5
telecine repack proper dual multi dualaudio 2audio subs multisub subbed dubbed raws chs cht eng jpn kor chi fre ger span ita rus
""".split()
WEB_WORDS = """
www http https httpd ftp ftps magnet btih urn dn tr com org net io info edu gov mil sample trailer screenshot thumb cover
folder backup cache temp
""".split()
LANGUAGES = """
fr es it pt nl de ru pl jp kr cn br mx ca au se no dk fi tr gr ar il ir th vn id my ph in za ng ke eg sa ae tw hk uk us ch
""".split()
STOP_WORDS = """
the and of to in by with for from is it or on at as an be that this are was were been being have has had do does did will
would can could should may might must shall but if then than so not no nor only own same too very just dont now into over
under again once here there when where why how which who whom whose what all any both each few more most other some such out
up down off about above below a we you your they them their our us
""".split()
CATEGORY_WORDS = """
movie movies game games anime manga music comic comics novel novels book books film films tv show shows hentai doujin
doujinshi drama dramas cartoon cartoons documentary documentaries album albums serial series action adult adventure comedy
horror romance thriller fantasy scifi sci genre story stories
""".split()
CODES = """
fr es it pt nl de ru pl us uk jp kr cn br mx ca au se no dk fi tr gr ar il ir th vn id my ph in za ng ke eg sa ae
""".split()


def noise_class(term: Column) -> Column:
    """Why a term tells nothing: the first kind that fits; null if none."""
    t = F.lower(term)
    return (
        F.when(t.isin(*FILE_FORMATS), "file format")
        .when(t.rlike("(?i)" + RESOLUTION), "resolution")
        .when(t.isin(*CODECS), "codec or source tag")
        .when(t.isin(*WEB_WORDS), "web or path")
        .when(t.isin(*LANGUAGES), "language or region")
        .when(t.isin(*STOP_WORDS), "stop word")
    )


def noise_summary(stats: DataFrame) -> DataFrame:
    """noise, terms and doc_count of each kind."""
    kinds = stats.select(F.coalesce(noise_class(F.col("term")), F.lit("kept")).alias("noise"), "doc_count")
    return kinds.groupBy("noise").agg(F.count("*").alias("terms"), F.sum("doc_count").alias("doc_count"))


def filter_candidates(stats: DataFrame, filtered: DataFrame, dictionary: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """term, doc_count and reason of broad terms: frequent dictionary words that are no category, and language codes."""
    low = without(stats.withColumn("term", F.lower("term")), filtered).where(F.col("term").rlike(r"^[\x20-\x7e]+$") & ~F.col("term").isin(*CATEGORY_WORDS))
    common = dictionary.select(F.lower(F.trim("term")).alias("term")).where(F.col("term").rlike("^[a-z]{2,}$")).distinct().withColumn("known", F.lit(True))
    reason = F.when(F.col("known") & (F.col("doc_count") >= min_docs), "dictionary word").when(F.col("term").isin(*CODES), "language code")
    return low.join(common, "term", "left").withColumn("reason", reason).where("reason is not null").select("term", "doc_count", "reason")
