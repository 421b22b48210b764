"""Question-answer datasets from spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.running import sums_before
from ..functions.text import portable_hash, word_count
from ..shipping import ship
from ..staging import written
from .lexicon import Entry, questions
from .spans import Found, greedy, told

ANSWER = "array<struct<start:int,text:string>>"


def templates(spark: SparkSession, labels) -> DataFrame:
    """label, template_no, question."""
    return spark.createDataFrame([(label, i, q) for label in labels for i, q in enumerate(questions(label))], "label string, template_no int, question string")


def default_question(label: Column) -> Column:
    return F.concat(F.lit("What is the "), F.lower(F.replace(label, F.lit("_"), F.lit(" "))), F.lit("?"))


def chosen(spans: DataFrame, *, most: int = 10, key: str = "doc_id") -> DataFrame:
    """At most `most` spans for each document and label: first one of each text (whatever its case) by position, then further ones by position. Groups of `most` or fewer stay whole."""
    group = W.partitionBy(key, "label")
    again = F.row_number().over(W.partitionBy(key, "label", F.lower("text")).orderBy("start"))
    # dealt by document once, for both windows and what is grouped by document and label afterwards
    seen = spans.repartition(key).withColumn("again", again)
    return seen.withColumn("pick", F.row_number().over(group.orderBy((F.col("again") > 1).cast("int"), "start"))).where(F.col("pick") <= most).drop("again", "pick")


def groups(spans: DataFrame, *, fewest: int = 1, key: str = "doc_id") -> DataFrame:
    """key, label, n, first, answers (start, text), by position, of the labels with `fewest` spans or more in a document."""
    item = F.struct(F.col("start").cast("int").alias("start"), "text")
    made = spans.groupBy(key, "label").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.array_sort(F.collect_list(item)).alias("answers"))
    return made.where(F.col("n") >= fewest)


class _Chosen:
    """The spans of a document and label, which come by position: the first ones of each text, and further ones, `most` of either."""

    def __init__(self, most: int) -> None:
        self._most, self._seen, self._first, self._further = most, set(), [], []

    def add(self, lowered: str | None, span: tuple[int, str | None]) -> None:
        if len(self._first) < self._most:
            if lowered not in self._seen:
                self._seen.add(lowered)
                self._first.append(span)
            elif len(self._further) < self._most:
                self._further.append(span)

    def spans(self) -> list[tuple[int, str | None]]:
        return sorted(self._first + self._further[: self._most - len(self._first)], key=lambda s: (s[0], s[1] is not None, s[1] or ""))


def chosen_groups(spans: DataFrame, *, fewest: int = 1, most: int = 10, in_order: bool = False, key: str = "doc_id") -> DataFrame:
    """groups() of chosen(), from one reading of the spans by position, which holds at most 2 * most spans of each label.

    in_order: spans already come document by document and by position, as spans.resolved() gives them; others are sorted first.
    """
    ship(spans.sparkSession)
    given = spans.select(key, "label", "start", "text", F.lower("text").alias("lowered__")).where("start IS NOT NULL")
    given = given if in_order else given.repartition(key).sortWithinPartitions(key, "start")
    answers = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", spans.schema["text"].dataType)]))
    kind = T.StructType([spans.schema[key], spans.schema["label"], T.StructField("n", T.LongType()), T.StructField("first", spans.schema["start"].dataType), T.StructField("answers", answers)])

    def table(done: list, like: pa.Schema) -> pa.RecordBatch:
        done = [(own, s) for own, g in done if len(s := g.spans()) >= fewest]
        every, to = [x for _, s in done for x in s], [0]
        for _, s in done:
            to.append(to[-1] + len(s))
        items = pa.StructArray.from_arrays([pa.array([x[0] for x in every], pa.int32()), pa.array([x[1] for x in every], like.field("text").type)], ["start", "text"])
        own = [pa.array([o[i] for o, _ in done], like.field(c).type) for i, c in enumerate((key, "label"))]
        first = pa.array([s[0][0] for _, s in done], like.field("start").type)
        return pa.RecordBatch.from_arrays([*own, pa.array([len(s) for _, s in done], pa.int64()), first, pa.ListArray.from_arrays(pa.array(to, pa.int32()), items)], kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, like = None, {}, None
        for batch in batches:
            done, like = [], batch.schema
            for doc, label, start, text, lowered in zip(*(batch.column(c).to_pylist() for c in like.names), strict=True):
                if doc != now:
                    done += [((now, own), g) for own, g in held.items()]
                    now, held = doc, {}
                if label not in held:
                    held[label] = _Chosen(most)
                held[label].add(lowered, (start, text))
            yield table(done, like)
        if held:
            yield table([((now, own), g) for own, g in held.items()], like)

    return given.mapInArrow(run, kind)


def scanned_groups(docs: DataFrame, entries: Sequence[Entry], *, fewest: int = 1, most: int = 10, key: str = "doc_id") -> DataFrame:
    """chosen_groups() of the resolved matches of entries that all have a form that reads once, each with its document's text and `n__`, the text's length: texts are dealt once, and neither spans nor groups are."""
    labels = [e.label for e in entries]
    kind = T._parse_datatype_string(f"groups__ array<struct<label:string,n:long,first:long,answers:{ANSWER}>>")

    def tell(found: list[Found]) -> tuple:
        held: dict[str, _Chosen] = {}
        for start, _, i, text in greedy(found):
            held.setdefault(labels[i], _Chosen(most)).add(text.lower(), (start, text))
        given = [(label, g.spans()) for label, g in held.items()]
        return ([(label, len(s), s[0][0], s) for label, s in given if len(s) >= fewest],)

    each = told(docs.select(key, "text"), entries, tell, kind, key=key)
    # rows without a key meet no spans
    return each.where(F.col(key).isNotNull()).select(key, "text", F.length("text").alias("n__"), F.explode("groups__").alias("g__")).select(key, "text", "n__", "g__.*")


def unique_texts(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, label, start, text of the first span of each text, whatever its case, within a document and label."""
    nth = F.row_number().over(W.partitionBy(key, "label", F.lower("text")).orderBy("start"))
    return spans.withColumn("nth", nth).where("nth = 1").select(key, "label", "start", "text")


def anchored(answers: Column, text: Column, length: Column | None = None) -> Column:
    """Answers whose slice of the text is right, others moved to their first exact occurrence; out of bounds or absent ones go. length: the text's, where it is at hand, since counting code points reads the whole text."""
    n = F.length(text) if length is None else length

    def place(a: Column) -> Column:
        inside = (a["start"] < n) & (a["start"] + F.length(a["text"]) <= n)
        exact = F.substr(text, a["start"] + 1, F.length(a["text"])) == a["text"]
        return F.when(inside & exact, a["start"]).when(inside, F.nullif(F.instr(text, a["text"]) - 1, F.lit(-1)))

    moved = F.transform(answers, lambda a: F.struct(place(a).cast("int").alias("start"), a["text"].alias("text")))
    return F.filter(moved, lambda a: a["start"].isNotNull())


def window_start(answers: Column, text: Column, most: int, length: Column | None = None) -> tuple[Column, Column]:
    """Start and end of the context: the text if it isn't longer than `most`, its beginning if the answers lie too far apart, else the answers with equal room on both sides, moved inside."""
    n = F.length(text) if length is None else length
    low = F.array_min(F.transform(answers, lambda a: a["start"]))
    high = F.array_max(F.transform(answers, lambda a: a["start"] + F.length(a["text"])))
    room = F.floor((F.lit(most) - (high - low)) / 2).cast("int")
    start, end = F.greatest(F.lit(0), low - room), F.least(n, high + room)
    whole = n <= most
    prefix = ~whole & ((high - low) > most)
    final_start = F.when(whole | prefix, F.lit(0)).when((start > 0) & (end == n), F.greatest(F.lit(0), n - most)).otherwise(start)
    final_end = F.when(whole, n).when(prefix, F.lit(most)).when(start == 0, F.least(n, F.lit(most))).otherwise(end)
    return final_start.cast("int"), final_end.cast("int")


def placed_pairs(docs: DataFrame, spans: DataFrame | Sequence[Entry], *, most_context: int = 4000, fewest: int = 1, most: int = 10, in_order: bool = False, key: str = "doc_id") -> DataFrame:
    """id, key, label, number, answers, from, to, begins: the pairs of pairs() without texts, as a table. in_order: see chosen_groups. spans: or entries, whose resolved matches are the spans; see scanned_groups.

    from and to bound the context in the text; begins marks a document's first
    pair. Texts meet the spans once, the answers are placed once for each row,
    and all that follows reads these narrow rows. Ids number the pairs in order
    of document and first span: counts of ranges of documents come first, so
    that numbering takes no single-task sort.
    """
    return _numbered(_placed(docs, spans, most_context, fewest, most, in_order, key).drop("row__"), key)


def _placed(docs: DataFrame, spans: DataFrame | Sequence[Entry], most_context: int, fewest: int, most: int, in_order: bool, key: str) -> DataFrame:
    """key, label, first, answers, from, to and row__, a number of the row's own, as a table."""
    # a length is taken once for each text; the filter stays behind the write, since before it Spark would place the answers again to test them
    if isinstance(spans, DataFrame):
        met = docs.select(key, "text", F.length("text").alias("n__")).join(chosen_groups(spans, fewest=fewest, most=most, in_order=in_order, key=key), key)
    else:
        met = scanned_groups(docs, spans, fewest=fewest, most=most, key=key)
    met = met.select(key, "label", "first", "n__", anchored(F.col("answers"), F.col("text"), F.col("n__")).alias("answers"))
    placed = written(met, "placed").where(F.size("answers") > 0)
    start, end = window_start(F.col("answers"), F.lit(None).cast("string"), most_context, F.col("n__"))
    return written(placed.select(key, "label", "first", "answers", start.alias("from"), end.alias("to"), F.monotonically_increasing_id().alias("row__")), "pairs")


def _numbered(placed: DataFrame, key: str) -> DataFrame:
    numbered = global_number(placed, [key, "first", "label"], key, first="begins")
    return numbered.withColumn("id", F.concat(F.col(key).cast("string"), F.lit("_q"), F.col("number").cast("string"), F.lit("_"), "label"))


def pairs(docs: DataFrame, spans: DataFrame | Sequence[Entry], templates_: DataFrame, *, seed: int = 42, most_context: int = 4000, fewest: int = 1, most: int = 10, in_order: bool = False, key: str = "doc_id", splits: bool = False) -> DataFrame:
    """id, key, label, question, context, answers, begins: one row for each document and label with an answer left.

    The question is picked by a hash of document, label and seed. See placed_pairs.
    splits: with the `split` that split() gives, told from ids alone, so that contexts and answers aren't shuffled by it.
    """
    placed = _placed(docs, spans, most_context, fewest, most, in_order, key)
    if splits:
        ids = split(_numbered(placed.select(key, "label", "first", "row__"), key).select("id", key, "row__", "begins"), seed=seed)
        own = ids.groupBy(key).agg(F.collect_list(F.struct("row__", "id", "begins", "split")).alias("own__"))
        made = placed.join(own, key).withColumn("own__", F.filter("own__", lambda x: x["row__"] == F.col("row__"))[0])
        made = made.select(key, "label", "answers", "from", "to", "own__.id", "own__.begins", "own__.split")
    else:
        made = _numbered(placed, key)
    made = made.join(docs.select(key, "text"), key)
    made = made.withColumn("context", F.substr("text", F.col("from") + 1, F.col("to") - F.col("from")))
    made = made.withColumn("answers", F.transform("answers", lambda a: F.struct((a["start"] - F.col("from")).cast("int").alias("start"), a["text"].alias("text"))))
    n_templates = templates_.groupBy("label").agg(F.count("*").alias("n_t"))
    pick = portable_hash(F.concat_ws("|", F.col(key).cast("string"), "label", F.lit(str(seed))))
    # templates are a lexicon's: joined by shuffle, all contexts of a label would meet in one task
    made = made.join(F.broadcast(n_templates), "label", "left").withColumn("template_no", F.pmod(pick, F.col("n_t")).cast("int"))
    made = made.join(F.broadcast(templates_), ["label", "template_no"], "left").withColumn("question", F.coalesce("question", default_question(F.col("label"))))
    return made.select("id", key, "label", "question", "context", "answers", "begins", *["split"] * splits)


def global_number(df: DataFrame, order: list[str], key: str, first: str | None = None) -> DataFrame:
    """df with `number` from 1 in the given order, which begins with the integer column key; `first`, where given, names a column that marks the first row of each key.

    df is read several times, so it should be a table. A row's number is its
    place among the rows of its key, and the rows of all smaller keys.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n__"))
    base = sums_before(written(counts, "counts"), key, "n__").select(key, "base")
    local = F.row_number().over(W.partitionBy(key).orderBy(*order))
    out = df.join(base, key).withColumn("number", F.col("base") + local)
    return (out.withColumn(first, F.col("number") == F.col("base") + 1) if first else out).drop("base")


def ratios(train: float, validation: float, test: float) -> tuple[float, float, float]:
    """Shares that add up to 1: as given if their sum is within 0.01 of it, else scaled."""
    total = train + validation + test
    return (train, validation, test) if abs(total - 1) <= 0.01 else (train / total, validation / total, test / total)


def with_ratios(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the shares in `columns` brought to a sum of 1, as ratios() does; a row whose sum is 0 gets nulls."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return rows.withColumns({c: F.when(F.abs(total - 1) <= 0.01, F.col(c)).otherwise(F.try_divide(F.col(c), total)) for c in columns})


def split(rows: DataFrame, *, by: str = "id", train: float = 0.7, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with `split`: in order of a hash of `by` and seed, the first int(n train) are for training, the next int(n validation) for validation, the rest for testing.

    Give a document's id as `by` to keep a document in one split. The place in
    the order comes from counts of hash ranges and a local rank. What becomes of
    an id is written out, so rows are read twice, for their ids and at the end.
    """
    train, validation, _ = ratios(train, validation, test)
    ids = written(rows.select(F.col(by).cast("string").alias("k")).distinct(), "ids")
    keys = ids.withColumn("h", F.md5(F.concat(F.col("k"), F.lit(f"|{seed}"))))
    keys = keys.withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))  # 4096 of them
    counts = keys.groupBy("range").agg(F.count("*").alias("c"))
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("base"), F.sum("c").over(W.partitionBy()).alias("n"))
    placed = keys.join(F.broadcast(counts), "range").withColumn("place", F.col("base") + F.row_number().over(W.partitionBy("range").orderBy("h", "k")))
    first, second = (F.col("n") * F.lit(train)).cast("int"), (F.col("n") * F.lit(validation)).cast("int")
    part = F.when(F.col("place") <= first, "train").when(F.col("place") <= first + second, "validation").otherwise("test")
    return rows.join(placed.select("k", part.alias("split")), F.col(by).cast("string") == F.col("k")).drop("k")


def dataset_statistics(rows: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row: pairs, documents, pairs for each document, pairs for each split."""
    part = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}")
    return rows.agg(F.count("*").alias("n_pairs"), F.countDistinct(key).alias("n_docs"), (F.count("*") / F.countDistinct(key)).alias("mean_pairs"), part("train"), part("validation"), part("test"))


def observed_statistics(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows, and what dataset_statistics() says of them, counted while they are written. `begins` marks a document's first pair."""
    seen = Observation("dataset")
    docs = F.count(F.when(F.col("begins"), 1))
    part = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}")
    return rows.observe(seen, F.count("*").alias("n_pairs"), docs.alias("n_docs"), F.try_divide(F.count("*"), docs).alias("mean_pairs"), part("train"), part("validation"), part("test")), seen


def issues(example: DataFrame) -> DataFrame:
    """example with `issues`, an array of texts that is empty for a valid row.

    Columns id, question, context and answers(text, answer_start); a null is a
    missing field. A row marked `unparsable` by parsed_examples has this issue.
    The first defect of structure ends the check; after that each answer is
    checked for bounds and text.
    """
    text, start, context = F.col("answers.text"), F.col("answers.answer_start"), F.col("context")
    unparsable = F.when(F.col("unparsable"), F.lit("line is no JSON object")) if "unparsable" in example.columns else F.lit(None).cast("string")
    structure = F.coalesce(
        unparsable,
        *[F.when(F.col(f).isNull(), F.lit(f"field {f} is missing")) for f in ("id", "question", "context", "answers")],
        F.when(text.isNull() | start.isNull(), F.lit("answers lack texts or starts")),
        F.when(F.size(text) != F.size(start), F.lit("texts and starts differ in number")),
        F.when(F.size(text) == 0, F.lit("no answer")),
    )

    def answer(x: Column, i: Column) -> Column:
        t, s, name = x["t"], x["s"], F.concat(F.lit("answer "), i.cast("string"))
        found = F.instr(context, t) - 1
        outside = F.concat(name, F.lit(" starts at "), s.cast("string"), F.lit(", outside of "), F.length(context).cast("string"), F.lit(" characters"))
        absent = F.concat(name, F.lit(" is absent: "), F.substring(t, 1, 50))
        moved = F.concat(name, F.lit(" stands at "), found.cast("string"), F.lit(" instead of "), s.cast("string"))
        return (
            F.when(t.isNull() | s.isNull(), F.concat(name, F.lit(" has no text or no start")))
            .when((s < 0) | (s >= F.length(context)), outside)
            .when(F.substr(context, s + 1, F.length(t)) == t, F.lit(None))
            .when(found < 0, absent)
            .otherwise(moved)
        )

    answers = F.filter(F.transform(F.arrays_zip(text.alias("t"), start.alias("s")), answer), lambda x: x.isNotNull())
    return example.withColumn("issues", F.when(structure.isNotNull(), F.array(structure)).otherwise(answers))


def issue_histogram(checked: DataFrame, k: int = 10) -> DataFrame:
    return checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(k)


def validation_report(checked: DataFrame) -> DataFrame:
    """total, valid, invalid, valid_percentage, invalid_percentage. checked may hold a boolean column `unparsable`, whose rows are invalid."""
    good = F.size("issues") == 0
    ok = F.count(F.when(good, 1))
    share = lambda n: F.try_divide(n * 100.0, F.count("*"))
    return checked.agg(F.count("*").alias("total"), ok.alias("valid"), (F.count("*") - ok).alias("invalid"), share(ok).alias("valid_percentage"), share(F.count("*") - ok).alias("invalid_percentage"))


def valid_label_counts(checked: DataFrame) -> DataFrame:
    """label, n of the valid rows; a row without label counts as `unknown`."""
    return checked.where(F.size("issues") == 0).groupBy(F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def checked_summary(checked: DataFrame, k: int = 10) -> tuple[dict, list, list]:
    """The figures of validation_report(), the k commonest issues and the labels of valid rows, each with its count, from one reading of the rows."""
    seen = Observation("checked")
    ok = F.count(F.when(F.size("issues") == 0, 1))
    watched = checked.observe(seen, F.count("*").alias("total"), ok.alias("valid"), (F.count("*") - ok).alias("invalid"), F.try_divide(ok * 100.0, F.count("*")).alias("valid_percentage"), F.try_divide((F.count("*") - ok) * 100.0, F.count("*")).alias("invalid_percentage"))
    issue = F.transform("issues", lambda i: F.struct(F.lit("issue").alias("kind"), i.alias("value")))
    label = F.array(F.struct(F.lit("label").alias("kind"), F.coalesce("label", F.lit("unknown")).alias("value")))
    counted = watched.select(F.explode(F.when(F.size("issues") == 0, label).otherwise(issue)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "value"))
    top = counted.withColumn("place", place).where((F.col("place") <= k) | (F.col("kind") == "label")).orderBy("kind", "place").collect()
    return seen.get, [(r["value"], r["n"]) for r in top if r["kind"] == "issue"], [(r["value"], r["n"]) for r in top if r["kind"] == "label"]


def label_counters(pairs_: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """label, pairs, documents, answers of a dataset."""
    return pairs_.groupBy("label").agg(F.count("*").alias("n_pairs"), F.countDistinct(key).alias("n_docs"), F.sum(F.size("answers")).alias("n_answers"))


def parsed_examples(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, question, context, answers, label and unparsable of each line of JSON; a line that is no JSON object has nulls and is marked."""
    text = F.col(column)
    fields = "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>, metadata struct<entity_label:string>"
    broken = F.try_parse_json(text).isNull() | ~F.startswith(F.trim(text), F.lit("{"))
    x = lines.select(F.from_json(text, fields).alias("x"), F.coalesce(broken, F.lit(True)).alias("unparsable"))
    return x.select("x.id", "x.question", "x.context", "x.answers", F.col("x.metadata.entity_label").alias("label"), "unparsable")


def word_statistics(rows: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """n, documents, and mean, least and most words of question and context."""
    measure = lambda c: [f(word_count(F.col(c))).alias(f"{name}_{c}_words") for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return rows.agg(F.count("*").alias("num_examples"), F.countDistinct(key).alias("num_docs"), *measure("question"), *measure("context"))


def training_pairs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """question, context of the rows that have both."""
    out = rows.where((F.col("question") != "") & (F.col("context") != "")).select("question", "context")
    return out.limit(most) if most is not None else out


def warm_up(n: Column, *, batch: int = 32, epochs: int = 3, ratio: float = 0.1) -> Column:
    """warm_up_steps() of a column of numbers of examples."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(ratio) * F.ceil(n / batch) * epochs))


def warm_up_steps(n: int, *, batch: int = 32, epochs: int = 3, ratio: float = 0.1) -> int:
    return max(1, int(ratio * -(-n // batch) * epochs))
