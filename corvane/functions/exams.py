"""Exam booklets and answer keys: page clean-up and classes, sections by a line-state machine, criteria, pairing.

A file is one row of text. Its lines are exploded with their places, states run over them in order, and rows come out by
section, so nothing larger than a file meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import rules
from corvane.functions.text import drop_cap, falsy, keyword_class

# How the files mark questions, pages, sections and points (patterns here and below are their formats).
_QUESTION = r"(?iu)(QUEST[ÃA]O\s+\d+|PEÇA\s+PRÁTICO|PEÇA\s+JUR[ÍI]DICA)"


def _phrases(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur, of any case."""
    low = F.lower(c)
    return sum((low.contains(p.lower()).cast("int") for p in phrases), F.lit(0))


def filled_lines(c: Column) -> Column:
    """The trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")


#: White space of any kind, as ``(?U)\\s`` matches.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; a pattern would try every place of the text."""
    return F.trim(c, F.lit(_SPACE))


def clean_page(c: Column, cover: Sequence[str] = rules.COVER_PHRASES) -> Column:
    """A page without running headers, footers and page marks, and without a cover of two phrases or more before its first question."""
    x = drop_cap(c)
    x = F.regexp_replace(x, r"(?s)ORDEM DOS ADVOGADOS DO BRASIL\n.*?Exame de Ordem Unificado\n.*?\n.*?\n", "")
    x = F.regexp_replace(x, r"Padrão de Resposta.*?Página \d+ de \d+", "")
    x = F.regexp_replace(x, r"PROVA PRÁTICO-PROFISSIONAL – PÁGINA \d+", "")
    x = F.regexp_replace(x, r"QUESTÃO \d+ – PÁGINA \d+", "")
    at = F.regexp_instr(x, F.lit(_QUESTION))
    head = F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise("")
    x = F.when((at > 0) & (_phrases(head, cover) >= 2), F.substring(x, at, F.length(x))).otherwise(x)
    return trimmed(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_statement(c: Column, noise: Sequence[str] = rules.NOISE_PHRASES) -> Column:
    """A statement without lines that carry a noise phrase, short fragments and marks left by the text extraction."""
    def keep(line: Column) -> Column:
        low = line["low"]  # made once a line: a name of an expression is a computation
        fragment = (F.length(low) < 10) & low.rlike(r"^[•·\-*]?\s*[a-z]")
        noisy = F.lit(False)
        for phrase in noise:
            noisy = noisy | low.contains(phrase.lower())
        return (low == "") | ~(noisy | fragment | low.rlike(r"examinando(?!\s+deve)"))

    lines = F.transform(F.split(c, "\n"), lambda line: F.struct(line.alias("line"), trimmed(F.lower(line)).alias("low")))
    x = F.array_join(F.transform(F.filter(lines, keep), lambda line: line["line"]), "\n")
    x = F.regexp_replace(x, r"\(cid:\d+\)", "")
    x = F.regexp_replace(x, r"(?m)\s*•\s*$", "")
    return trimmed(F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), " {2,}", " "))


def is_writing_page(c: Column) -> Column:
    """Fewer than three filled lines, or more than 70 % of them numbers alone."""
    lines = filled_lines(c)
    numbers = F.size(F.filter(lines, lambda x: x.rlike(r"^\d+$")))
    return (F.size(lines) < 3) | (numbers > 0.7 * F.size(lines))


def is_instruction_page(c: Column, phrases: Sequence[str] = rules.INSTRUCTION_PHRASES) -> Column:
    """Three marking phrases or more; or two, with neither a numbered question nor the text of a document task."""
    n, low = _phrases(c, phrases), F.lower(c)
    real = low.rlike(r"quest[ãa]o\s+\d+\b") | low.rlike(r"(?s)peça\s+prático-profissional\s*[\n\r].{200,}")
    return (n >= 3) | ((n >= 2) & ~real)


def booklet_text(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, text): the pages that hold questions, cleaned, in order."""
    kept = pages.where(~is_writing_page(F.col(text)) & ~is_instruction_page(F.col(text)))
    rows = kept.select(key, F.struct(F.col(page).alias("p"), clean_page(F.col(text)).alias("t")).alias("x"))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return found.select(key, F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("text"))


def document_task(c: Column) -> Column:
    """The statement of the document task: from its heading to the first question."""
    found = F.regexp_extract(c, r"(?isu)PEÇA PRÁTICO-PROFISSIONAL\s*(.*?)(?=QUESTÃO\s+1\b|$)", 1)
    return clean_statement(F.regexp_replace(found, r"(?s)^ATENÇÃO\n.*?identificação\.\n", ""))


def booklet_questions(booklets: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, statement, part_a, part_b, value_a, value_b) of each numbered question of a booklet."""
    # A plain explode infers filters that split the text again.
    blocks = booklets.select(key, F.explode_outer(F.split(text, r"(?iu)\n(?=QUESTÃO\s+\d+\b)")).alias("block"))
    number = F.regexp_extract("block", r"(?iu)^QUESTÃO\s+(\d+)\b", 1).try_cast("int")
    body = trimmed(F.regexp_replace("block", r"(?iu)^QUESTÃO\s+\d+\b\s*", ""))
    rows = blocks.select(key, number.alias("number"), body.alias("body")).where("number IS NOT NULL")
    values = F.transform(F.regexp_extract_all("body", F.lit(r"Valor:\s*(\d+[,.]\d+)\)"), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double"))
    rows = rows.withColumn("values", values)
    first = F.coalesce(F.array_position(F.transform("values", lambda v: v != 0), True), F.lit(0))
    rows = rows.withColumn("first", first).withColumn("at", F.regexp_instr("body", F.lit(r"(?i)\nB\)")))
    after = F.slice("values", F.col("first") + 1, F.size("values"))
    value_a = F.when(F.col("first") > 0, F.get("values", F.col("first") - 1)).otherwise(0.0)
    value_b = F.when((F.col("first") > 0) & (F.size(after) > 0), F.element_at(after, -1)).otherwise(0.0)
    part_a = F.when(F.col("at") > 0, trimmed(F.substring("body", F.lit(1), F.col("at") - 1))).otherwise(F.col("body"))
    part_b = F.when(F.col("at") > 0, trimmed(F.substring("body", F.col("at"), F.length("body")))).otherwise("")
    return rows.select(key, "number", clean_statement(F.col("body")).alias("statement"), clean_statement(part_a).alias("part_a"),
                       clean_statement(part_b).alias("part_b"), value_a.alias("value_a"), value_b.alias("value_b"))


# Lines that open a section of an answer key (three layouts over the years), and lines that open a part of a section.
DOCUMENT_SECTION = (r"(?iu)PADRÃO DE RESPOSTA.*PEÇA", r"(?iu)^((TIPO\s+DE\s+)?QUEST[ÃA]O\s*:\s*)?PEÇA PRÁTICO-PROFISSIONAL\s*$")
COUNTED_SECTION = r"(?iu)^(TIPO\s+DE\s+)?QUEST[ÃA]O\s*:\s*QUEST[ÃA]O\s+DISCURSIVA\s*$"
NUMBERED_SECTION = (r"(?iu)PADRÃO DE RESPOSTA.*QUESTÃO\s+0?(\d+)", r"(?iu)^QUESTÃO\s+(\d+)\s*$")
PARTS = (("key", r"(?iu)^Gabarito Comentado\s*$"), ("points", r"(?iu)^Distribuição dos Pontos\s*$"),
         ("statement", r"(?iu)^(Enunciado|ENUNCIADO DA QUESTÃO DISCURSIVA)\s*$"))


def answer_key_sections(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, number, answer, points, statement) of each section that has an answer or points.

    A state machine over lines: a section line sets the question (null for the document task; a counted one takes the next
    number) and clears the part; a part line sets what the lines after it belong to. Lines before any part line are left out.
    """
    # A plain posexplode infers filters that split the text again.
    lines = files.select(key, F.posexplode_outer(filled_lines(F.col(text))).alias("pos", "line")).where("line IS NOT NULL")
    line = F.col("line")
    document = line.rlike(DOCUMENT_SECTION[0])
    counted = ~document & line.rlike(COUNTED_SECTION)
    document = document | (~counted & line.rlike(DOCUMENT_SECTION[1]))
    number = F.coalesce(*(F.regexp_extract(line, rx, 1).try_cast("int") for rx in NUMBERED_SECTION))
    numbered = ~document & ~counted & number.isNotNull()
    opened = F.coalesce(*(F.when(line.rlike(rx), F.lit(name)) for name, rx in PARTS))
    marked = lines.select(key, "pos", "line", document.alias("document"), counted.alias("counted"), F.when(numbered, number).alias("number"), opened.alias("opened"))
    marked = marked.withColumn("starts", F.col("document") | F.col("counted") | F.col("number").isNotNull())
    upto = Window.partitionBy(key).orderBy("pos")
    states = marked.withColumn("section", F.sum(F.col("starts").cast("int")).over(upto))
    states = states.withColumn("number", F.when(F.col("counted"), F.sum(F.col("counted").cast("int")).over(upto)).otherwise(F.col("number")))
    part = F.last(F.when(~F.col("starts"), F.col("opened")), ignorenulls=True).over(Window.partitionBy(key, "section").orderBy("pos"))
    states = states.withColumn("part", part)
    content = ~F.col("starts") & F.col("opened").isNull()

    def joined(name: str) -> Column:
        some = F.array_sort(F.collect_list(F.when(content & (F.col("part") == name), F.struct("pos", "line"))))
        return F.array_join(F.transform(some, lambda x: x["line"]), "\n")

    out = states.groupBy(key, "section").agg(F.max("number").cast("int").alias("number"), joined("key").alias("answer"), joined("points").alias("points"), joined("statement").alias("statement"))
    return out.where((F.col("answer") != "") | (F.col("points") != ""))


def criteria(sections: DataFrame, keys: Sequence[str], points: str) -> DataFrame:
    """(keys, place, criterion, text, points) of the items of a point table; lines that open no item belong to the one before.

    The points of an item are the greatest two-digit number up to 5 in its text, else the first number in brackets of its first line.
    """
    lines = sections.select(*keys, F.posexplode(filled_lines(F.col(points))).alias("pos", "line"))
    lines = lines.where(~F.col("line").startswith("ITEM") & ~F.col("line").startswith("PONTUAÇÃO"))
    opening = r"^([A-Z\d]+(?:\.\d+)?)\.\s+(.+)"
    rows = lines.withColumn("item", falsy(F.regexp_extract("line", opening, 1)))
    rows = rows.withColumn("place", F.sum(F.col("item").isNotNull().cast("int")).over(Window.partitionBy(*keys).orderBy("pos")))
    rows = rows.where((F.col("place") > 0) & (F.col("item").isNotNull() | ~F.col("line").rlike(r"^0[,.]\d+")))
    piece = F.when(F.col("item").isNotNull(), F.regexp_extract("line", opening, 2)).otherwise(F.col("line"))
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    bracket = F.when(F.col("item").isNotNull(), number(F.regexp_extract(F.regexp_extract("line", opening, 2), r"\((\d+[,.]\d+)\)", 1)))
    folded = rows.groupBy(*keys, "place").agg(F.max("item").alias("criterion"), F.coalesce(F.max(bracket), F.lit(0.0)).alias("bracket"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))).alias("x"))
    text = trimmed(F.array_join(F.transform("x", lambda x: x["t"]), " "))
    folded = folded.withColumn("t", text)
    found = F.transform(F.regexp_extract_all("t", F.lit(r"(?<!\d)(\d{1,2}[,.]\d{2})(?!\d)"), F.lit(1)), number)
    best = F.array_max(F.filter(found, lambda v: (v > 0) & (v <= 5.0)))
    plain = trimmed(F.regexp_replace("t", r"\s+\d+[,.]\d+(?:/\d+[,.]\d+)+\s*$", ""))
    plain = trimmed(F.regexp_replace(plain, r"\s+\(\d+[,.]\d+\)\s*$", ""))
    return folded.select(*keys, "place", "criterion", plain.alias("text"), F.round(F.coalesce(best, "bracket"), 2).alias("points"))


def file_area(name: Column) -> Column:
    return keyword_class(name, rules.FILE_AREAS, other="Desconhecida")


def document_type(answer: Column) -> Column:
    return keyword_class(answer, rules.DOCUMENT_TYPES, other="Peça Processual")


def exam_files(files: DataFrame, exam: str, name: str) -> DataFrame:
    """(exam, area, booklet, key): for each area one booklet (the shortest name) and one answer key (a final one before a preliminary one)."""
    low = F.lower(F.col(name))
    marked = files.select(F.col(exam).alias("exam"), F.col(name).alias("name"), file_area(low).alias("area"), low.contains("caderno").alias("is_booklet"),
                          F.when(low.contains("gabarito_def"), F.when(low.contains("prelim"), 1).otherwise(0))
                          .when(low.contains("gabarito") & low.contains("prelim") & low.contains("2fase"), 2).alias("rank"))
    booklet = F.min(F.when(F.col("is_booklet"), F.struct(F.length("name").alias("l"), "name")))
    answer = F.min(F.when(F.col("rank").isNotNull() & ~F.col("is_booklet"), F.struct("rank", "name")))
    both = marked.groupBy("exam", "area").agg(booklet.alias("b"), answer.alias("k"))
    return both.select("exam", "area", F.col("b.name").alias("booklet"), F.col("k.name").alias("key")).where("booklet IS NOT NULL AND key IS NOT NULL")


def paired_questions(questions: DataFrame, sections: DataFrame, on: Sequence[str]) -> DataFrame:
    """Questions with the answer of their number; a missing statement is taken from the answer key. Questions without either are left out."""
    answers = sections.where("number IS NOT NULL").select(*on, "number", "answer", "points", F.col("statement").alias("inline"))
    both = answers.join(questions.select(*on, "number", "statement"), [*on, "number"], "left")
    return both.withColumn("statement", F.coalesce(falsy(F.col("statement")), falsy(F.col("inline")))).where("statement IS NOT NULL").drop("inline")


def training_only(df: DataFrame, folder: str, held_out: Sequence[int] = tuple(rules.EVALUATION_EXAMS)) -> DataFrame:
    """Rows of exam folders that are kept for training: no benchmark folder, no held-out number; folders without a number are left out."""
    number = F.regexp_extract(folder, r"exame(\d+)", 1).try_cast("int")
    return df.withColumn("exam", number).where(F.col("exam").isNotNull() & ~F.col(folder).contains("benchmark") & ~F.col("exam").isin(*held_out))
