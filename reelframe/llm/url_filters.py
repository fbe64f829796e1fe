"""URL filters: host and path rules first, then logistic regression on hashed character n-grams; native functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import table

#: (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words of the labelled table, by families.
JUNK_WORDS = tuple(
    "casino poker slots roulette jackpot bets betting lottery bingo gambling "
    "ads adserver adclick banners popunder clicks affiliate track tracker tracking pixel beacon "
    "adult xxx porn sex cams escorts nude dating "
    "pills viagra cialis meds pharma steroids diet "
    "loans payday forex crypto bonus prize winner win rich cash money "
    "spam seo backlinks linkfarm links followers traffic "
    "cheap replica watches discount outlet deals buy free "
    "warez cracked torrents keygen".split()
)
ORDINARY_WORDS = tuple(
    "library museum garden harbour weather university school hospital theatre kitchen recipes cycling travel science journal music archive maps "
    "history village council forest river mountain bakery market gallery painting poetry grammar dictionary language physics chemistry biology "
    "geology astronomy football tennis chess rowing hiking sailing railway airport station bridge castle cathedral parish orchestra choir dance "
    "film radio newspaper magazine publisher bookshop printing software compiler database network hardware robot laboratory institute academy "
    "farm orchard vineyard fishing wildlife birds insects flowers trees animals veterinary dentist nursing therapy health safety insurance law "
    "court police fire rescue charity family children parents wedding birthday holiday hotel camping island beach desert valley lake glacier".split()
)
#: Words that stand beside either kind.
NEUTRAL_WORDS = tuple("club online best shop zone hub now top world plus my the go pro center store web site daily first".split())
#: What stands around the name of a host, dealt to either kind alike, so that it says nothing by itself.
AROUND = ("http://{}.example.com/", "https://www.{}.example.org/a/12", "http://m.{}.test.example/en/7", "https://{}.site.example/p.html", "http://blog.{}.example.net/de/3", "https://{}.example.org/", "http://news.{}.home.example/x?id=5", "https://www.{}.example.com/fr/81#top")


def made_up_names(n: int) -> list[str]:
    """Names without meaning, by a rule: consonants and vowels in turn, two to four syllables."""
    consonants, vowels = "bcdfghjklmnprstvwz", "aeiou"
    out = []
    for i in range(n):
        x, name = i * 7919 + 101, ""
        for _ in range(2 + i % 3):
            name += consonants[x % 18] + vowels[x // 18 % 5] + consonants[x // 90 % 18] * (x // 3 % 2)
            x = x * 31 // 7 + 17
        out.append(name)
    return out


def _hosts(words: tuple[str, ...]) -> list[str]:
    """Eight names for each word: twice alone, twice with a number, with two words of its own kind and with two neutral ones, joined or not."""
    n, m = len(words), len(NEUTRAL_WORDS)
    out = []
    for i, w in enumerate(words):
        out += [w, w, f"{w}{10 + 7 * i % 90}", f"{1 + i % 9}{w}", f"{w}-{words[(5 * i + 7) % n]}", f"{words[(11 * i + 3) % n]}{w}", f"{w}-{NEUTRAL_WORDS[i % m]}", f"{NEUTRAL_WORDS[(3 * i + 1) % m]}{w}"]
    return out


def labelled_table() -> list[tuple[str, int]]:
    """The small table that the classifier learns from: (url, 1 blocks), built by rule from the words above; under two thousand urls, two in seven junk."""
    junk, plain = _hosts(JUNK_WORDS), _hosts(ORDINARY_WORDS)
    plain += made_up_names(max(0, 5 * len(junk) // 2 - len(plain)))
    return [(AROUND[i % len(AROUND)].format(name), label) for label, names in ((1, junk), (0, plain)) for i, name in enumerate(names)]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(text of the longest rule that fits, its verdict); null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def ngram_buckets(host: Column, path: Column, *, buckets: int, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """Hash buckets of the character n-grams of host and of path, each with its start and end marked."""

    def grams(mark: str, text: Column) -> list[Column]:
        edged = F.concat(F.lit("^"), text, F.lit("$"))
        return [of_size(edged, mark, n) for n in sizes]

    def of_size(edged: Column, mark: str, n: int) -> Column:
        at = F.when(F.length(edged) >= n, F.sequence(F.lit(1), F.length(edged) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(edged, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(*grams("h", host), *grams("p", path))


def fit_url_model(labelled: DataFrame, *, buckets: int = 32_768, reg: float = 1e-4) -> tuple[list[float], float]:
    """(weight of each bucket, intercept) from labelled(url, label): which buckets a url has counts, not how often; null urls and labels are left out."""
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL")
    rows = known.select(F.array_distinct(ngram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets=buckets)).cast("array<string>").alias("b"), F.col("label").cast("double").alias("label")).coalesce(1).cache()
    counts = CountVectorizer(inputCol="b", outputCol="counts", binary=True, vocabSize=buckets).fit(rows)
    vectors = counts.transform(rows).cache()
    model = LogisticRegression(featuresCol="counts", regParam=reg, standardization=False, maxIter=50).fit(vectors)
    weights = [0.0] * buckets
    for bucket, w in zip(counts.vocabulary, model.coefficients.toArray().tolist(), strict=True):
        weights[int(bucket)] = w
    vectors.unpersist()
    rows.unpersist()
    return weights, float(model.intercept)


def url_filter(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, buckets: int = 32_768, threshold: float = 0.5) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of each page.

    The longest rule that fits decides; otherwise the classifier blocks from `threshold` on.  A null url, or one
    without ://, has an empty host and path, so the classifier judges it without a single n-gram.  A very long url is judged
    by all its n-grams; repeated rows give repeated results; an empty table gives no rows.  Extra columns are ignored.
    """
    weights, intercept = fit_url_model(labelled, buckets=buckets)
    table_of = F.split(F.lit(",".join(f"{x:.6g}" for x in weights)), ",").cast("array<double>")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("b", F.array_distinct(ngram_buckets(F.col("host"), F.col("path"), buckets=buckets)))
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + F.get(table_of, x))
    score = 1 / (1 + F.exp(-(F.lit(intercept) + total)))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.withColumn("score", score).withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, judged)).drop("b")


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_table(), "url string, label int")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")
