"""Questions and options in free text: lines get a kind, running sums part them into islands, each island is a question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match


@dataclass(frozen=True)
class LineRules:
    """Patterns that tell what a line is; each must be found in it.  ``number`` and ``label`` capture, ``prefix`` and ``bullet`` are cut off."""

    noise: str
    question: str
    option: str
    bullet: str
    number: str
    prefix: str
    stem: str
    label: str
    section: str
    field: str
    required: str
    optional: str
    scale: str
    mark: str
    statement: str
    heading: str
    default_scale: tuple[str, ...]


# How questionnaires mark questions, options and scales.
RULES = LineRules(
    noise=r"^[0-9]+(\.[0-9]+)?$|^[0-9]+(\.[0-9]+)?\s*mm$|^[A-Z_]{3,}$|^그림입니다\.?$|원본\s*그림의\s*(이름|크기)|\.(bmp|png|jpe?g)|^#?[0-9A-Fa-f]{6}$",
    question=r"^(Q\s*)?[0-9]+(\s*[-–]\s*[0-9]+)?\s*[.)．、]\s*\S+|^[Qq][0-9]+(\s*[-–]\s*[0-9]+)?\s*[.)．、:]\s*\S+|^[SsDd][Qq]?\s*[0-9]+\s*[.)．、:]\s*\S+|^(문항|질문|문)\s*[0-9]+|^\[\s*문항\s*[0-9]+\s*\]",
    option=r"^[①②③④⑤⑥⑦⑧⑨⑩○●◎□■☐☑ⓐⓑⓒⓓⓔ]|^[가나다라마바사아자차카타파하]\s*[.)．]|^[-•▪◦]\s+\S+|^(매우\s*만족|만족|보통|불만족|매우\s*불만족|예|아니오|남|여|남성|여성|동의|비동의)( |$)|^[0-9]+\s*대( |$)",
    bullet=r"^([①②③④⑤⑥⑦⑧⑨⑩○●◎□■☐☑ⓐⓑⓒⓓⓔ]\s*[.)．]?\s*|[가나다라마바사아자차카타파하]\s*[.)．]\s*|[-•▪◦]\s+)",
    number=r"^\D{0,6}([0-9]+)",
    prefix=r"^((DQ|SQ|S|D|Q)?\s*[0-9]+(\s*[-–]\s*[0-9]+)?\s*[.)．、:]\s*|(문항|질문|문)\s*[0-9]+\s*[.)．:]?\s*|\[\s*문항\s*[0-9]+\s*\]\s*)",
    stem=r"아래\s*제시.*(중요|필요|선택해\s*주십시오)|^[Qq]\s*[0-9]+.*(평가해\s*주시기\s*바랍니다|대해서?\s*평가)",
    label=r"^([Qq]\s*[0-9]+(\s*[-–]\s*[0-9]+)?)",
    section=r"^[ⅣⅤⅥⅦⅧⅨⅩIVX0-9]+[.．、)]|^[ⅣⅤⅥⅦⅧⅨⅩ]",
    field=r"^(성명|이름|연락처|휴대폰|휴대전화|전화번호|이메일|주소|생년월일|소속|학번|성별|나이|연령)\s*([:：(]|$)",
    required=r"필수|[Rr]equired|반드시\s*(응답|작성)",
    optional=r"선택\s*(사항|응답)|해당\s*시|[Oo]ptional",
    scale=r"불만족|보통|만족|그렇지\s*않다|아니다|그렇다|낮음|높음",
    mark=r"^[○●◎□■☐☑①②③④⑤⑥⑦⑧⑨⑩]$",
    statement=r"(다|까|요|인가)\s*[.…]?$",
    heading=r"(주관|주최|시행|조사기관|운영기관)\s*[:：]",
    default_scale=("매우 불만족", "불만족", "보통", "만족", "매우 만족"),
)
LEAST_STATEMENT, MOST_STATEMENT, MOST_HINT, LEAST_SCALE = 8, 120, 40, 3


def text_lines(docs: DataFrame, key: str, text: str, rules: LineRules) -> DataFrame:
    """key, line_no and line: the lines of each text with single spaces, without empty ones and noise."""
    plain = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit(" "), F.lit(" "))
    rows = docs.select(key, F.posexplode(F.split(plain, "\n")).alias("line_no", "_l"))
    rows = rows.select(key, "line_no", F.trim(F.regexp_replace("_l", r"[ \t\r\f\x0B]+", " ")).alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike(rules.noise))


def cells_of(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def with_kinds(lines: DataFrame, rules: LineRules) -> DataFrame:
    """``lines`` with kind, title and values: what each line is, what it asks, and the options or scale labels it gives."""
    line, cells = F.col("line"), F.col("_cells")
    rows = lines.withColumn("_cells", F.when(F.contains("line", F.lit("|")), cells_of(line)).otherwise(F.array().cast("array<string>")))
    scale = F.filter(cells, lambda c: c.rlike(rules.scale))
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    marks = (F.size(rest) >= LEAST_SCALE) & F.forall(rest, lambda c: c.rlike(rules.mark)) & (F.length(F.get(cells, F.lit(0))) >= 2)
    small = F.forall(cells, lambda c: c.rlike(rules.option) | c.rlike(rules.scale) | c.rlike(rules.mark))
    said = F.filter(cells, lambda c: c.rlike(rules.statement) & (F.length(c) >= LEAST_STATEMENT))
    question = line.rlike(rules.question) & ~line.rlike(rules.option)
    statement = line.rlike(rules.statement) & F.length(line).between(LEAST_STATEMENT, MOST_STATEMENT)
    hint = (line.rlike(rules.required) | line.rlike(rules.optional)) & (F.length(line) < MOST_HINT)
    table = F.size(cells) >= 2
    kind = first_match([
        (table & (F.size(scale) >= LEAST_SCALE), "scale"), (table & marks, "item"), (table & small, "options"), (table & (F.size(said) > 0), "item"), (table, "row"),
        (question & line.rlike(rules.stem), "stem"), (question, "question"), (line.rlike(rules.field), "field"), (line.rlike(rules.option), "option"), (hint, "hint"), (statement, "statement"),
    ], "other")
    bare = lambda c: F.trim(F.regexp_replace(c, rules.bullet, ""))
    title = F.when(table & marks, F.get(cells, F.lit(0))).when(table, F.get(said, F.lit(0))).otherwise(line)
    title = F.when(question | (table & marks), F.coalesce(F.nullif(F.trim(F.regexp_replace(title, rules.prefix, "")), F.lit("")), title)).otherwise(title)
    values = F.when(table & (F.size(scale) >= LEAST_SCALE), scale).when(table & small, F.transform(cells, bare)).when(~table & line.rlike(rules.option), F.array(bare(line)))
    return rows.select("*", kind.alias("kind"), title.alias("title"), F.filter(values, lambda v: v != "").alias("values")).drop("_cells")


def questions(docs: DataFrame, key: str, text: str, rules: LineRules = RULES) -> DataFrame:
    """key, place, number, title, required, options and confidence: the questions in each text, in order of ``place``, a line number.

    A question, a field or a row of a grid opens an island of lines, whose number is a running
    sum of openers; lines of options and hints belong to the island's question if it is one that
    waits for them.  Grid rows take the last scale named above them, and the label of the last
    stem that no other question or section followed.  Statements count where no question is open.
    Of questions with one title in a text the first place stays, with the longest list of options.

    All of it is windows within a text, in order of its lines: no text is gathered in one value.
    Null and empty texts have no questions; ``key`` must tell texts apart; texts without openers
    give statements alone; an empty table gives no rows; other columns are not read.
    """
    own = Window.partitionBy(key).orderBy("line_no")
    kinds = with_kinds(text_lines(docs, key, text, rules), rules)
    kind = F.col("kind")
    opener = kind.isin("question", "field", "item", "stem")
    section = kind.isin("other", "statement", "hint") & F.col("line").rlike(rules.section)
    marker = F.when(kind == "stem", F.struct(F.nullif(F.regexp_replace(F.regexp_extract("line", rules.label, 1), " ", ""), F.lit("")).alias("label")))
    marker = marker.when((kind == "question") | section, F.struct(F.lit(None).cast("string").alias("label")))
    default = F.array(*[F.lit(x) for x in rules.default_scale])
    rows = kinds.select(
        key, "line_no", "line", "kind", "title", "values", F.sum(opener.cast("int")).over(own).alias("island"),
        F.coalesce(F.last(F.when(kind == "scale", F.col("values")), ignorenulls=True).over(own), default).alias("scale"),
        F.last(marker, ignorenulls=True).over(own)["label"].alias("stem"),
    )
    island = Window.partitionBy(key, "island").orderBy("line_no")
    rows = rows.withColumn("waits", F.coalesce(F.first("kind").over(island).isin("question", "field") & (F.col("island") > 0), F.lit(False)))
    asks = kind.isin("question", "field", "item") | ((kind == "statement") & ~F.col("waits"))
    belongs = F.col("waits") & kind.isin("option", "options", "hint")
    # Statements outside an open question are islands of one line.
    rows = rows.where(asks | belongs).withColumn("part", F.when(kind == "statement", F.col("line_no")).otherwise(-1))
    head = lambda c: F.first(F.when(asks, c), ignorenulls=True)
    required = F.col("line").rlike(rules.required) & ~F.col("line").rlike(rules.optional)
    said = F.when(asks, F.struct("line_no", required.alias("r"))).when(kind == "hint", F.struct("line_no", (~F.col("line").rlike(rules.optional)).alias("r")))
    titled = F.when((kind == "item") & F.col("stem").isNotNull(), F.concat("stem", F.lit(") "), "title")).otherwise(F.col("title"))
    number = F.when(kind == "question", F.nullif(F.regexp_extract("line", rules.number, 1), F.lit("")).try_cast("int"))
    grouped = rows.groupBy(key, "island", "part").agg(
        F.min(F.when(asks, F.col("line_no"))).alias("place"), head(titled).alias("title"), head(number).alias("number"), F.max(said)["r"].alias("required"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(kind.isin("option", "options"), F.struct("line_no", "values")))), lambda x: x["values"])).alias("listed"),
        head(F.when(kind == "item", F.col("scale"))).alias("scale"), head(first_match([(kind == "statement", "low"), (kind == "field", "high")], "medium")).alias("confidence"),
        head(F.col("line")).alias("_line"),
    )
    found = grouped.where(~F.col("_line").rlike(rules.heading) & (F.length("title") >= 2)).withColumn("options", F.coalesce("scale", "listed"))
    best = found.groupBy(key, F.regexp_replace("title", r"\s+", "").alias("_t")).agg(
        F.min("place").alias("place"), F.max_by(F.struct("number", "title", "required", "options", "confidence"), F.struct(F.size("options"), -F.col("place"))).alias("q")
    )
    return best.select(key, "place", "q.*")


def options_of(asked: DataFrame, key: str) -> DataFrame:
    """key, place, option_no and option of questions with options."""
    return asked.select(key, "place", F.posexplode("options").alias("option_no", "option"))
