"""Scalar text functions, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import rules


def falsy(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(falsy(c) for c in cols))


def squeeze(c: Column) -> Column:
    """White space of any kind to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def sanitize_markdown(c: Column) -> Column:
    """From the first node marker on, without bold, italics, headings and rules; runs of blank lines become one."""
    at = F.locate("<<ID=", c)
    x = F.when(at > 0, F.substr(c, at)).otherwise(c)
    x = F.replace(x, F.lit("**"), F.lit(""))
    x = F.regexp_replace(x, r"\*(?!\s)([^*]{1,3000}?)(?<!\s)\*", "$1")
    lines = F.filter(F.split(x, "\n"), lambda line: ~line.rlike(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"))
    lines = F.transform(lines, lambda line: F.regexp_replace(line, r"^\s{0,3}#{1,6}\s*", ""))
    lines = F.transform(lines, lambda line: F.regexp_replace(F.regexp_replace(line, r"^\s*\*([^*]+)\*\s*$", "$1"), r"(?U)\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def strip_fence(c: Column) -> Column:
    """A fenced JSON block without its fence, cut to its outermost braces."""
    # Neither fence holds a brace, so the braces are looked for first and the text is named twice only: a name is a computation.
    return F.coalesce(falsy(F.regexp_extract(c, r"(?s)\{.*\}", 0)), F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))


def yes_no(c: Column) -> Column:
    """1 for the word SIM, 0 for NÃO or NO, 1 for SIM anywhere, else 0; in this order."""
    x = F.upper(F.trim(c))
    return F.when(x.rlike(r"(?U)\bSIM\b"), 1).when(x.rlike(r"(?U)\bN[ÃA]O\b|\bNO\b"), 0).when(x.contains("SIM"), 1).otherwise(0)


def truthy(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).isin("1", "True", "true"), F.lit(False))


def starts_yes(c: Column) -> Column:
    return F.lower(F.trim(c)).startswith("s").cast("int")


def joined_key(a: Column, b: Column) -> Column:
    """``a-b``; null where a part is missing."""
    return F.when(falsy(a.cast("string")).isNotNull() & falsy(b.cast("string")).isNotNull(), F.concat_ws("-", a.cast("string"), b.cast("string")))


def normal_id(c: Column) -> Column:
    """Without white space, dots, dashes and slashes, in capitals."""
    return F.upper(F.regexp_replace(c, r"(?U)[\s./-]", ""))


def slug(c: Column, n: int = 80) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), 1, n)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "")


def keyword_class(c: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "Outras") -> Column:
    """The first class, in declared order, one of whose keywords occurs."""
    out = None
    low = F.lower(c)
    for name, keys in rules:
        hit = F.lit(False)
        for key in keys:
            hit = hit | low.contains(key.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def alias(c: Column, names: dict[str, str], default: str) -> Column:
    """Canonical name of a trimmed, lower-cased value."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.lit(default))


def initials(c: Column) -> Column:
    """Initials of the first four capitalised words, else LEI."""
    caps = F.slice(F.regexp_extract_all(c, F.lit(r"([A-ZÁÉÍÓÚ])[a-záéíóú]+"), F.lit(1)), 1, 4)
    return F.coalesce(falsy(F.upper(F.array_join(caps, ""))), F.lit("LEI"))


def statute_code(c: Column, codes: Sequence[tuple[str, str]] = tuple(rules.STATUTE_CODES)) -> Column:
    """The canonical code of a statute's name, else its initials."""
    found = [F.when(F.lower(c).contains(part.lower()), F.lit(code)) for part, code in codes]
    return F.coalesce(*found, initials(c))


def statute_number(c: Column, prefix: str) -> Column:
    """``prefix``, number without dots and year of a name such as ``Lei 9.099/1995``; null where there is none."""
    rx = r"(\d[\d.]*)\s*/\s*(\d{4})"
    number = falsy(F.regexp_extract(c, rx, 1))
    return F.concat(F.lit(prefix), F.replace(number, F.lit("."), F.lit("")), F.lit("-"), F.regexp_extract(c, rx, 2))


def process_number(given: Column, text: Column) -> Column:
    """The given process number, else the first that the text names, else empty."""
    rx = r"((?:REsp|AREsp|HC|RHC|CC|MS|AgInt|EDcl)[\s.\d\-/A-Z]{4,25})"
    return F.coalesce(falsy(given), F.trim(F.regexp_extract(text, rx, 1)))


def case_area(subject: Column, kind: Column) -> Column:
    return keyword_class(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(kind, F.lit(""))), rules.AREA_KEYWORDS)


def criterion_class(title: Column) -> Column:
    """``formal`` for the titles that ask for form, else ``merito``."""
    return F.when(F.lower(F.trim(F.coalesce(title, F.lit("")))).isin(*rules.FORMAL_TITLES), "formal").otherwise("merito")


def genre(c: Column) -> Column:
    """A genre's canonical name; an empty one is the discursive genre, an unknown one stays."""
    low = F.lower(F.trim(F.coalesce(falsy(c), F.lit("discursiva"))))
    return F.coalesce(F.element_at(_literal_map(rules.GENRE_ALIAS), low), low)


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def messages(kind: Column, statement: Column, systems: dict[str, str] = rules.SYSTEM_PROMPTS) -> Column:
    """System and user turns: the genre's instruction (the discursive one for an unknown genre) and the bare statement."""
    table = _literal_map(systems)
    system = F.coalesce(F.element_at(table, genre(kind)), F.lit(systems["discursiva"]))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", F.regexp_replace(F.coalesce(statement, F.lit("")), r"(?U)^\s+|\s+$", "")))


def fill(template: str, **values: Column) -> Column:
    """A template whose ``{name}`` marks are replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def strip_case_marker(c: Column) -> Column:
    """A statement without the marker ``### CASO ###`` that it may begin with."""
    return F.regexp_replace(F.regexp_replace(c, r"^#*\s*CASO\s*#*\s*", ""), r"(?U)^\s+|\s+$", "")


def is_narrative(c: Column) -> Column:
    """Whether a statement, its marker line left out, tells a case: neither empty nor opened like a pleading."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), r"^#*\s*CASO[^\n]*\n", "")
    return (text != "") & ~text.rlike(rules.PLEADING_OPENING)


def condition_label(c: Column, regimes: dict[str, str], models: dict[str, str]) -> Column:
    """A condition's name in words; a name of another form stays as it is, and so does a regime or model without a label."""
    def named(table: dict[str, str], key: Column) -> Column:
        return F.coalesce(F.element_at(_literal_map(table), key), key) if table else key

    tuned, base = r"(?i)^sft_([ivx]+)_(\w+?)_s(\d+)_([\w.]+)$", r"(?i)^ab_(\w+?)_s(\d+)_([\w.]+)$"
    part = lambda rx, k: F.regexp_extract(c, rx, k)
    label = lambda block, regime, seed, model: F.concat(F.lit("bloco "), block, F.lit(" · "), named(regimes, regime), F.lit(" · semente "), seed, F.lit(" · "), F.coalesce(F.element_at(_literal_map(models), F.lower(model)), model) if models else model)
    return F.when(c.rlike(tuned), label(F.upper(part(tuned, 1)), part(tuned, 2), part(tuned, 3), part(tuned, 4))).when(
        c.rlike(base), label(F.lit("0"), part(base, 1), part(base, 2), part(base, 3))).otherwise(c)


def question_id(exam: Column, kind: str, area: Column, number: Column | None = None) -> Column:
    """``exam-disc-area-n`` or ``exam-peca-area``, with the area's short code."""
    code = F.coalesce(F.element_at(_literal_map(rules.AREA_CODES), F.lower(area)), area)
    return F.concat_ws("-", exam.cast("string"), F.lit(kind), code, *([] if number is None else [number.cast("string")]))


def token_count(c: Column) -> Column:
    """The default count of tokens: words between white space. Callers with a tokenizer pass their own expression."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def document_header(summary_of: Column | None = None) -> Column:
    """The three header lines of a document row: its mark, its filled facts, its summary."""
    f = F.col
    name = first_filled(f("processo"), F.trim(F.concat_ws(" ", f("classe"), f("numero"))))
    court = F.concat(f("tribunal"), F.when(f("orgao") != "", F.concat(F.lit(" ("), f("orgao"), F.lit(")"))).otherwise(""))
    facts = F.concat_ws(" · ", name, court, F.when(f("relator") != "", F.concat(F.lit("Rel. "), f("relator"))), F.when(f("data") != "", F.concat(F.lit("j. "), f("data"))))
    made = summary(f("ementa"), F.lit(None).cast("string") if summary_of is None else summary_of, f("texto"))
    return F.concat(F.lit("<<JURIS|BRUTO|"), f("tribunal"), F.lit("|"), first_filled(f("processo"), f("id")), F.lit(">>\n[DECISÃO] "), facts, F.lit("\n[RESUMO DA DECISÃO] "), made)


def comma_number(c: Column, digits: int = 1, signed: bool = False) -> Column:
    """A number with a decimal comma, halves rounded to even; null becomes a dash."""
    return F.when(c.isNull(), "—").otherwise(F.translate(F.format_string(f"%{'+' if signed else ''}.{digits}f", F.bround(c, digits)), ".", ","))


def parse_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def up_down(c: Column, band: float = 0.3) -> Column:
    return F.when(c > band, "up").when(c < -band, "down").otherwise("")


def summary(given: Column, made: Column, text: Column, most: int = 1200, least: int = 300) -> Column:
    """The first filled of both summaries, cut; else the head of the text, up to its last sentence end if that lies beyond ``least``."""
    head = F.substring(text, 1, most)
    back = F.locate(" .", F.reverse(head))
    end = F.length(head) - back  # characters up to the last full stop before a space
    cut = F.when((back > 0) & (end - 1 > least), F.substring(head, F.lit(1), end)).otherwise(head)
    return F.coalesce(F.substring(falsy(given), 1, most), F.substring(falsy(made), 1, most), cut)


def header(parts: Sequence[Column], extra: Column) -> Column:
    """Filled parts joined by a middle dot, then the summary on its own line."""
    return F.concat_ws("\n", F.concat_ws(" · ", *(falsy(p) for p in parts)), falsy(extra))


def sentence_chunks(c: Column, target: int) -> Column:
    """Sentences packed in order into chunks of up to ``target`` characters (a longer sentence stands alone)."""
    sentences = F.split(c, r"(?<=[.;:])\s+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["cur"] == "") | (F.length(s["cur"]) + 1 + F.length(x) <= target)
        joined = F.when(s["cur"] == "", x).otherwise(F.concat_ws(" ", s["cur"], x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("cur"))

    packed = F.aggregate(sentences, start, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
    return F.when(F.length(c) <= target, F.array(c)).otherwise(packed)


ARTICLE = r"(?m)^\s*Art(?:igo)?\.?\s+(\d+(?:\.\d{3})*)"


def article_numbers(c: Column) -> Column:
    """Distinct article numbers, thousands separators and leading zeros removed."""
    found = F.regexp_extract_all(c, F.lit(ARTICLE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit("."), F.lit("")).cast("int")))


def articles(c: Column, thousands: bool = True) -> Column:
    """(number, body) of each article: its heading and the text up to the next one. Without ``thousands`` a number stops at its first dot.

    A letter after the number belongs to the heading (``75-A``) unless it begins a word.
    """
    number = r"\d+(?:\.\d{3})*" if thousands else r"\d+"
    heading = rf"(?m)(?:^|\n)\s*((?:Artigo|Art\.?)\s*{number}[º°]?[\s\-–.]*(?:[A-Z]\b)?[.\-]?)\s*"
    heads = F.regexp_extract_all(c, F.lit(heading), F.lit(1))
    parts = F.split(c, heading)
    bodies = F.slice(parts, F.lit(2), F.size(heads))
    value = lambda h: F.replace(F.regexp_extract(h, rf"({number})", 1), F.lit("."), F.lit("")).try_cast("int")
    return F.zip_with(heads, bodies, lambda h, b: F.struct(value(h).alias("number"), F.trim(F.concat_ws(" ", F.trim(h, F.lit(" \n\t\r")), F.trim(b, F.lit(" \n\t\r")))).alias("body")))


def references(c: Column) -> Column:
    """(court, type, number) of each cited precedent; the type SUM is tried before SUM:VINC, as results require."""
    rx = r"JURIS:(STF|STJ):(RG|REP|SUM|SUM:VINC)(?::VINC)?:(?:TEMA)?(\d+)"
    return F.arrays_zip(*(F.regexp_extract_all(c, F.lit(rx), F.lit(i)).alias(n) for i, n in ((1, "court"), (2, "type"), (3, "number"))))


def unescape(c: Column) -> Column:
    """Character references, by number and by name, as the characters they stand for; each is read once."""
    def char(ref: Column) -> Column:
        number = F.when(ref.startswith("#x") | ref.startswith("#X"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 9)).try_cast("long")
        valid = number.isNotNull() & (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(ref.startswith("#"), coded).otherwise(F.element_at(_literal_map({k: chr(v) for k, v in name2codepoint.items()} | {"apos": "'"}), ref))

    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    amp = F.filter(found, lambda r: char(r) == "&")
    other = F.filter(found, lambda r: (char(r) != "&") & char(r).isNotNull())

    def replaced(text: Column, refs: Column) -> Column:
        return F.aggregate(refs, text, lambda t, r: F.replace(t, F.concat(F.lit("&"), r, F.lit(";")), char(r)))

    return F.when(F.size(found) > 0, replaced(replaced(c, other), amp)).otherwise(c)


def html_text(c: Column) -> Column:
    """Text of a page: raw and frame elements dropped, block ends to line feeds, tags stripped, references read, blanks squeezed."""
    x = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer|aside|head)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n")
    x = unescape(F.regexp_replace(x, r"(?s)<[^>]+>", " "))
    x = F.regexp_replace(x, r"[ \t\x0B\f\r\xA0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r" ?\n ?", "\n"), r"\n{2,}", "\n"), F.lit(" \n"))


def drop_cap(c: Column) -> Column:
    """``Q 1`` and its torn ``UESTÃO`` put together, in both forms."""
    x = F.regexp_replace(c, r"\bQ\s*(\d+)\s*\n\s*UEST[ÃA]O\b", "QUESTÃO $1")
    return F.regexp_replace(x, r"\bQ\s*\n\s*UEST[ÃA]O\s*(\d+)\b", "QUESTÃO $1")


def first_of_role(messages: Column, role: str) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def content_id(key: Column, content: Column) -> Column:
    """The key where it is filled, else 12 digits of the content's MD5."""
    return F.coalesce(falsy(key), F.substring(F.md5(content.cast("binary")), 1, 12))
