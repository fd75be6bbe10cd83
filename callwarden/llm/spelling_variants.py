"""Spelling variants: frequent words one code point apart, found by pivotal bigrams.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.

* Bigrams are ordered by the number of words that hold them, rare ones first.  A word's prefix is its three
  first bigrams in that order, and every other place of the third one.
* Of its prefix a word keeps two pivots, bigrams that share no place, of least frequency together; a
  dynamic program over places finds them.  One change touches at most one of them, so the other one
  stands in every near word, moved by one place at most.
* Of two near words, take the one whose prefix ends earlier in the order: a surviving pivot of it
  lies in the prefix of the other.  So pivots meet prefixes by (bigram, place, length), for the five ways in
  which place and length can change together; what meets is verified.

Everything is SQL on the table of distinct words.  Equal bigrams at equal places of words of equal length are
the only rows that meet, and that join can be split where one key is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.storage import stored

#: Maximal runs of these are words; only A-Z are lower-cased.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Pairs of letters that are broadcast at most; the alphabet of RUNS has 8,100.
MOST_PAIRS = 100_000
#: (change of length, change of place) of a bigram that one change leaves whole.
SHIFTS = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run): every run of every text, lower-cased.  Null texts have none."""
    found = F.regexp_extract_all(lowered(docs[text]), F.lit(RUNS), F.lit(0))
    return docs.select(docs[key].alias("key"), F.explode(found).alias("run"))


def count_words(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): distinct words of at least so many code points and occurrences."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _grams(words: DataFrame) -> DataFrame:
    """(word, size, grams): bigrams of each word as (held by so many words, gram, place), rare ones first."""
    size = F.length("word")
    place = F.explode(F.sequence(F.lit(1), size - 1)).alias("place")
    single = words.select("word", size.alias("size"), place).withColumn("gram", F.expr("substr(word, place, 2)"))
    held = stored(single.groupBy("gram").agg(F.count("*").alias("held")))  # a row per pair of letters
    held = F.broadcast(held) if held.count() <= MOST_PAIRS else held
    rows = single.join(held, "gram").groupBy("word", "size")
    return rows.agg(F.array_sort(F.collect_list(F.struct("held", "gram", "place"))).alias("grams"))


def _prefix(grams: Column) -> Column:
    """The three rarest bigrams and what ties with the third."""
    third = F.element_at(grams, 3)
    return F.filter(grams, lambda g: F.struct(g["held"], g["gram"]) <= F.struct(third["held"], third["gram"]))


def _pivots(prefix: Column) -> Column:
    """Two bigrams of the prefix that share no place, of least frequency together.

    Over places in order: `one` is the best single bigram that ends before the last one seen,
    `last` is the last one seen, `pair` the best pair so far.
    """
    gram = "struct<held:bigint,gram:string,place:int>"
    spots = F.array_sort(F.transform(prefix, lambda g: F.struct(g["place"].alias("place"), g["held"].alias("held"), g["gram"].alias("gram"))))
    spots = F.transform(spots, lambda s: F.struct(s["held"].alias("held"), s["gram"].alias("gram"), s["place"].alias("place")))
    start = F.struct(
        F.lit(None).cast(gram).alias("one"), F.lit(None).cast(gram).alias("last"), F.lit(None).cast(f"struct<cost:bigint,a:{gram},b:{gram}>").alias("pair")
    )

    def step(acc: Column, x: Column) -> Column:
        apart = F.when(acc["last"]["place"] <= x["place"] - 2, acc["last"])
        with_one = F.when(acc["one"].isNotNull(), F.struct((acc["one"]["held"] + x["held"]).alias("cost"), acc["one"].alias("a"), x.alias("b")))
        with_last = F.when(apart.isNotNull(), F.struct((apart["held"] + x["held"]).alias("cost"), apart.alias("a"), x.alias("b")))
        return F.struct(
            F.coalesce(F.least(acc["one"], acc["last"]), acc["one"], acc["last"]).alias("one"),
            x.alias("last"),
            F.least(acc["pair"], with_one, with_last).alias("pair"),
        )

    pair = F.aggregate(spots, start, step)["pair"]
    return F.array(pair["a"], pair["b"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of distinct words exactly one inserted, deleted or replaced code point apart.

    `words` has a column `word` of distinct, non-null values; each has at least four code points, since
    shorter ones have no three bigrams: others raise an error.  No words, no pairs.
    """
    checked = words.select(F.when(F.length("word") >= 4, F.col("word")).otherwise(F.raise_error(F.lit("words need four code points"))).alias("word"))
    grams = stored(
        _grams(checked).withColumn("prefix", _prefix(F.col("grams"))).select(
            "word", "size", "prefix", _pivots(F.col("prefix")).alias("pivots"), F.element_at("grams", 3).alias("third")
        )
    )
    end = F.struct("third.held", "third.gram").alias("end")
    index = grams.select(F.col("word").alias("b"), F.col("size"), end, F.explode("prefix").alias("g"))
    index = index.select("b", "size", F.col("end").alias("b_end"), F.col("g.gram").alias("gram"), F.col("g.place").alias("place"))
    asked = grams.select(F.col("word").alias("a"), "size", end, F.explode("pivots").alias("g")).select(
        "a", F.col("end").alias("a_end"), F.col("g.gram").alias("gram"),
        F.explode(F.array(*[F.struct((F.col("size") + l).alias("size"), (F.col("g.place") + p).alias("place")) for l, p in SHIFTS])).alias("at"),
    ).select("a", "a_end", "gram", "at.size", "at.place")
    met = asked.join(index, ["gram", "place", "size"]).where((F.col("a_end") <= F.col("b_end")) & (F.col("a") != F.col("b")))
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: the last word reached by following forms.

    A form is more frequent than its word, so there are no circles; each round doubles the steps taken.
    """
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        links = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words.

    `form` is the near word of largest n, the smallest in code-point order of several, if its n is at least
    `ratio` times the word's own; else null, as for words with no near word.  `root` is where forms
    lead in the end, the word itself without one.  `ratio` is at least 2.  Runs actions.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word")
    words = stored(words.select("word", "n"))
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.n") >= F.col("n") * ratio
    judged = stored(
        joined.select(
            "word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, -F.col("best.n")).alias("form_n"),
        )
    )
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(found: DataFrame, every: int = 199) -> DataFrame:
    """(word): the runs (key, run), one in `every` of them without one of its code points.

    Which, and which code point, follows from the CRC-32 of `<key>:<run>`; a null key counts as empty.
    """
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "run"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 0) -> DataFrame:
    """`variants` of the words of the texts; with `every`, of the runs as `misspelt` changes them.

    Null and empty texts have no words; rows with a null key or of one key count like all others, and
    repeated rows count as often as they occur.  Other columns are ignored.  No texts, no rows.
    """
    found = runs(docs, key, text)
    words = misspelt(found, every) if every else found.select(F.col("run").alias("word"))
    return variants(count_words(words, least_length, least_count), ratio)


def spelling_sql(every: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> str:
    """The same over `documents`, for the check: words meet where one left-out code point makes them equal."""
    table = (
        "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    )
    value = lambda at: f"(strpos('0123456789ABCDEF', d[{at}]) - 1)"
    return f"""
WITH RECURSIVE crc_table AS (SELECT {table} AS t),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM found GROUP BY doc_id, run),
digits AS (SELECT run, c, string_split(hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))), '') AS d FROM counted),
summed AS (SELECT run, c, xor(list_reduce(
    list_concat([4294967295], list_transform(range(len(d) // 2), lambda i: {value("2 * i + 1")} * 16 + {value("2 * i + 2")})),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM digits, crc_table),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {every} = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, c FROM summed) s
  WHERE length(word) >= {least_length} GROUP BY word HAVING sum(c) >= {least_count}),
shorter AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words) w),
near AS (SELECT x.word AS a, y.word AS b FROM shorter x JOIN shorter y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest),
best AS (SELECT a, count(*) AS n_near, max(w.n) AS top FROM near JOIN words w ON w.word = near.b GROUP BY a),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {ratio} * w.n THEN top END AS form_n,
    CASE WHEN top >= {ratio} * w.n THEN (SELECT min(v.word) FROM near JOIN words v ON v.word = near.b WHERE near.a = w.word AND v.n = top) END AS form
  FROM words w LEFT JOIN best ON best.a = w.word),
walk AS (SELECT word, word AS root, form AS next FROM judged UNION ALL SELECT walk.word, j.word, j.form FROM walk JOIN judged j ON j.word = walk.next)
SELECT j.word, j.form, walk.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, CAST(j.form_n AS BIGINT) AS form_n
FROM judged j JOIN walk ON walk.word = j.word AND walk.next IS NULL"""
