"""Projections of raw court and statute tables to one document schema, and to cards for expansion.

Every function takes a table as read. A column that a source lacks counts as empty, like null, an empty text and the text
``None``. Ids, labels and templates are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules
from corvane.functions.text import articles, case_area, falsy, first_filled, process_number, squeeze, statute_code, statute_number
from corvane.operators.selection import first_n, stratified_sample

FIELDS = ("id", "fonte", "tribunal", "classe", "numero", "processo", "relator", "orgao", "data", "ementa", "texto")


def field(df: DataFrame, name: str) -> Column:
    """A column as text, empty where it is missing."""
    if name not in df.columns:
        return F.lit("")
    c = F.col(name).cast("string")
    return F.when(c.isNull() | (c == "None"), "").otherwise(c)


def _document(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(c, F.lit("")).alias(c) for c in FIELDS))


def stf_decisions(df: DataFrame) -> DataFrame:
    f = lambda n: field(df, n)
    return _document(df, id=F.concat(F.lit("BRUTO:STF:"), first_filled(f("processo"), f("doc_id"))), fonte=F.lit("STF — acórdão"), tribunal=F.lit("STF"), classe=f("classe"),
                     numero=f("numero"), processo=f("processo"), relator=f("relator"), orgao=f("orgao"), data=f("data_julgamento"), ementa=squeeze(f("ementa")), texto=squeeze(f("texto")))


def concentrated_control(df: DataFrame) -> DataFrame:
    f = lambda n: field(df, n)
    text = squeeze(f("ementa_texto"))
    return _document(df, id=F.concat(F.lit("BRUTO:STF:CC:"), first_filled(f("processo"), f("id"))), fonte=F.lit("STF — controle concentrado"), tribunal=F.lit("STF"), classe=f("classe"),
                     numero=f("numero"), processo=f("processo"), relator=f("relator_acordao_nome"), data=f("julgamento_data"), ementa=text, texto=text)


def stj_notes(df: DataFrame, position: str) -> DataFrame:
    """Bulletin notes; a missing process number is searched for in the text. ``position`` numbers the lines from 0."""
    f = lambda n: field(df, n)
    text = squeeze(f("texto"))
    return _document(df, id=F.concat_ws(":", F.lit("BRUTO:STJ:INFJ"), f("informativo"), F.col(position).cast("string")), fonte=F.lit("STJ — informativo"), tribunal=F.lit("STJ"),
                     numero=f("informativo"), processo=process_number(f("processo"), text), relator=f("relator"), orgao=f("orgao"), data=f("data"), texto=text)


def acordaos(stf: DataFrame, control: DataFrame, notes: DataFrame, position: str) -> DataFrame:
    """The three sources of single decisions as one table."""
    return reduce(DataFrame.unionByName, (stf_decisions(stf), concentrated_control(control), stj_notes(notes, position)))


def consolidated(df: DataFrame, prefix: str, source: str, court: str, kind: str, number: Column, text: Column, body: str | None = None, least: int = 30) -> DataFrame:
    """One of the sources of settled precedent; texts below ``least`` characters are left out."""
    text = squeeze(text)
    label = F.trim(F.concat_ws(" ", F.lit(kind), number))
    court_of = field(df, "tribunal") if court == "" else F.lit(court)
    court_of = F.when(court_of == "", "TJSP").otherwise(court_of)
    rows = df.withColumns({"__text": text, "__court": court_of})
    out = _document(rows, id=F.concat(F.lit(prefix), number), fonte=F.lit(source), tribunal=F.col("__court"), classe=F.lit(kind), numero=number,
                    processo=F.trim(F.concat(label, F.lit(" do "), F.col("__court"))), orgao=field(df, body) if body else F.lit(""), ementa=F.col("__text"), texto=F.col("__text"))
    return out.where(F.length("texto") >= least)


def question_and_thesis(title: Column, more: Column, thesis: Column) -> Column:
    return F.concat(F.lit("[QUESTÃO] "), squeeze(title), F.lit(" "), squeeze(more), F.lit("\n[TESE FIXADA] "), squeeze(thesis))


def with_thesis(df: DataFrame, column: str = "tese") -> DataFrame:
    """Precedents whose thesis is settled: the column is filled once blanks are squeezed."""
    return df.where(squeeze(field(df, column)) != "")


def summaries(df: DataFrame, court: str, binding: bool = False) -> DataFrame:
    """Numbered summaries of a court."""
    kind = "Súmula Vinculante" if binding else "Súmula"
    text = first_filled(field(df, "sumula_texto"), field(df, "texto"))
    tag = kind.upper().replace(" ", "") if court == "STF" else "SUM"
    source = f"{court} — {kind.lower()}"
    return consolidated(df, f"BRUTO:{court}:{tag}:", source, court, kind, field(df, "numero"), text, body="orgao_julgador")


def repetitive_themes(df: DataFrame) -> DataFrame:
    return consolidated(df, "BRUTO:STJ:TEMA:", "STJ — tema repetitivo", "STJ", "Tema repetitivo", F.coalesce(first_filled(field(df, "tema"), field(df, "numero")), F.lit("")), field(df, "tese"))


def general_repercussion(df: DataFrame) -> DataFrame:
    df = with_thesis(df)
    body = question_and_thesis(field(df, "titulo"), field(df, "descricao"), field(df, "tese"))
    return consolidated(df, "BRUTO:STF:RG:", "STF — repercussão geral", "STF", "Tema de repercussão geral", F.coalesce(first_filled(field(df, "tema"), field(df, "numero")), F.lit("")), body)


def incidents(df: DataFrame, kind: str, source: str, position: str) -> DataFrame:
    """Incidents of a court with a settled thesis; one without theme and number goes by its position."""
    df = with_thesis(df)
    number = first_filled(field(df, "tema"), field(df, "numero"), F.col(position).cast("string"))
    return consolidated(df, f"BRUTO:{kind}:", source, "", kind, number, question_and_thesis(field(df, "nome_tema"), field(df, "questao"), field(df, "tese")))


def court_csv(df: DataFrame, grade: str, position: str, least: int = 200) -> DataFrame:
    """Decisions of a state court's CSV; texts below ``least`` characters are left out, absent fields fall back."""
    f = lambda n: squeeze(field(df, n))
    number = F.trim(field(df, "nup"))
    place = F.col(position).cast("string")
    some = F.coalesce(first_filled(f("orgao_julgador"), f("vara")), F.lit(""))
    day = F.coalesce(first_filled(f("data_julgamento"), f("data_publicacao")), F.lit(""))
    out = df.select(F.concat(F.lit(f"BRUTO:TJSP:{grade}:"), first_filled(number, place)).alias("id"), F.lit("TJSP — " + grade.replace("_", "º ")).alias("fonte"), F.lit("TJSP").alias("tribunal"),
                    f("classe").alias("classe"), number.alias("numero"), first_filled(number, F.concat_ws(" ", f("classe"), place)).alias("processo"), f("magistrado").alias("relator"),
                    some.alias("orgao"), day.alias("data"), f("ementa").alias("ementa"), f("conteudo").alias("texto"), f("assunto").alias("assunto"), f("comarca").alias("comarca"))
    return out.where(F.length("texto") >= least)


# Cards for expansion.

CARD = ("fonte", "juris_id", "tipo", "tribunal", "identificador_label", "identificador_valor", "area", "status_vinculante", "documento")


def _card(df: DataFrame, *values: Column | str) -> DataFrame:
    return df.select(*((F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(CARD, values)))


def padded(c: Column, n: int = 4) -> Column:
    """Zeros before a number; a longer one stays whole."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def repercussion_cards(df: DataFrame) -> DataFrame:
    f = lambda n: field(df, n)
    df = df.where((f("descricao") != "") & (f("tema") != ""))
    text = F.concat(F.lit("Tema "), f("numero_tema"), F.lit(" — "), f("titulo"), F.lit("\n\nRelator: "), f("relator"), F.lit("\n\nDescrição/Tese:\n"), f("descricao"), F.lit("\n\nTítulo: "), f("tema"))
    return _card(df, "rg_stf", F.concat(F.lit("JURIS:STF:RG:TEMA"), padded(f("numero_tema"))), "Tese de Repercussão Geral", "STF", "Tema", f("numero_tema"), "", "Vinculante (art. 927, III, CPC)", text)


def theme_cards(df: DataFrame) -> DataFrame:
    f = lambda n: field(df, n)
    df = df.where(f("tese") != "")
    text = F.concat(F.lit("Tema Repetitivo STJ "), f("numero"), F.lit(" — "), f("titulo"), F.lit("\n\nTese:\n"), f("tese"), F.lit("\n\nLabel: "), f("label"))
    return _card(df, "temas_stj", F.concat(F.lit("JURIS:STJ:REP:TEMA"), padded(f("numero"))), "Tema Repetitivo", "STJ", "Tema", f("numero"), "", "Vinculante (art. 927, III, CPC)", text)


def summary_cards(df: DataFrame) -> DataFrame:
    """Cards of STF summaries; ``is_vinculante`` tells binding ones."""
    f = lambda n: field(df, n)
    binds = F.coalesce(F.col("is_vinculante").cast("boolean"), F.lit(False)) if "is_vinculante" in df.columns else F.lit(False)
    kind = F.when(binds, "Súmula Vinculante").otherwise("Súmula")
    name = F.concat(F.when(binds, "JURIS:STF:SUM:VINC:").otherwise("JURIS:STF:SUM:"), padded(f("sumula_numero")))
    text = F.concat(kind, F.lit(" "), f("sumula_numero"), F.lit(" — STF\n\n"), f("titulo"), F.lit("\n\nEnunciado:\n"), f("sumula_texto"))
    return _card(df, "sumulas_stf", name, kind, "STF", "Súmula", f("sumula_numero"), "", F.when(binds, "Vinculante (art. 103-A CF)").otherwise("Persuasivo"), text)


def note_cards(df: DataFrame, least: int = 150) -> DataFrame:
    """Cards of bulletin notes over ``least`` characters; a note without digits in its process number takes a digest of its text."""
    f = lambda n: field(df, n)
    df = df.where(F.length(f("texto")) > least)
    digits = F.substring(F.regexp_replace(f("processo"), r"\D", ""), 1, 10)
    name = F.concat(F.lit("JURIS:STJ:INFJ:"), padded(f("informativo")), F.lit(":"), first_filled(digits, stable_suffix(f("texto"))))
    return _card(df, "stj_acordaos", name, F.when(f("processo") != "", "Acórdão STJ").otherwise("Nota de Informativo STJ"), "STJ", "Informativo", f("informativo"), f("ramo"), "Persuasivo", f("texto"))


def stable_suffix(c: Column, n: int = 8) -> Column:
    """The last digits of a text's digest: the same in every run."""
    return F.substring(F.sha2(c.cast("binary"), 256), -n, n)


def binding(kind: Column, flagged: Column) -> Column:
    """Whether a decision binds: by its class of action, or flagged."""
    return F.coalesce(kind.isin(*rules.BINDING_CLASSES), F.lit(False)) | F.coalesce(flagged, F.lit(False))


def decision_cards(df: DataFrame, least: int = 300, limit: int | None = None) -> DataFrame:
    """Cards of STF decisions over ``least`` characters, those with a summary first, then those with a theme, then by length."""
    f = lambda n: field(df, n)
    rows = df.where(F.length(f("texto")) > least)
    if limit is not None:
        size = F.col("n_chars") if "n_chars" in df.columns else F.length(f("texto"))
        rows = rows.orderBy((f("ementa") != "").desc(), (f("tema_rg") != "").desc(), size.desc()).limit(limit)
    both = (f("classe") != "") & (f("numero") != "")
    name = F.when(both, F.concat_ws(":", F.lit("JURIS:STF"), f("classe"), f("numero"))).otherwise(F.concat(F.lit("JURIS:STF:"), F.coalesce(falsy(f("doc_id")), F.lit("?"))))
    flagged = F.col("is_repercussao_geral").cast("boolean") if "is_repercussao_geral" in df.columns else F.lit(False)
    text = F.when(f("tema_rg") != "", F.concat(F.lit("TEMA: "), f("tema_rg"), F.lit("\n\n"), f("texto"))).otherwise(f("texto"))
    status = F.when(binding(f("classe"), flagged), "Vinculante (efeito erga omnes)").otherwise("Persuasivo")
    return _card(rows, "stf_acordaos", name, F.concat(F.lit("Acórdão STF — "), f("classe")), "STF", "Processo", F.concat_ws(" ", f("classe"), f("numero")), "", status, F.substring(text, 1, 4000))


def case_id(df: DataFrame, court: str) -> Column:
    """The process number without slashes and dots, else twelve digits of the content's MD5."""
    number = F.replace(F.replace(F.coalesce(first_filled(field(df, "nup"), field(df, "processo")), F.lit("")), F.lit("/"), F.lit("-")), F.lit("."), F.lit(""))
    content = F.coalesce(first_filled(field(df, "conteudo"), field(df, "ementa")), F.lit(""))
    return F.concat(F.lit(f"CASE:{court.upper()}:"), first_filled(number, F.substring(F.md5(content.cast("binary")), 1, 12)))


def case_cards(df: DataFrame, court: str, key: str, n: int, first: int | None = None, least: int = 0, seed: int = 42) -> DataFrame:
    """Up to ``n`` cases of each area of law, drawn by a seeded order (of the area's ``first`` ones, if given) from summaries of ``least`` characters or more."""
    f = lambda c: field(df, c)
    rows = df.where(F.length(F.trim(f("ementa"))) >= least).withColumn("area", case_area(f("assunto"), f("classe")))
    rows = stratified_sample(rows, "area", key, n, seed, first)
    text = F.concat(F.lit(f"Tribunal: {court.upper()} | Classe: "), f("classe"), F.lit(" | Assunto: "), f("assunto"), F.lit(" | Data julgamento: "), f("data_julgamento"),
                    F.lit("\n\nEmenta:\n"), f("ementa"), F.lit("\n\nConteúdo:\n"), F.substring(F.coalesce(first_filled(f("conteudo"), f("ementa")), F.lit("")), 1, 3000))
    return rows.select(F.lit(court.lower()).alias("fonte"), case_id(rows, court).alias("case_id"), F.lit(court.upper()).alias("tribunal"), F.lit("2º grau").alias("instancia"), f("classe").alias("tipo_acao"),
                       first_filled(f("nup"), f("processo")).alias("processo"), f("data_julgamento").alias("data"), "area", text.alias("documento"))


def statute_articles(df: DataFrame, kind: str = "federal", least: int = 100, least_article: int = 30) -> DataFrame:
    """(id, doc_id, diploma, num_art, texto): the articles of statutes, one of each id, the longest text.

    ``kind`` tells how a statute is named: ``code`` by the canonical code of its name, ``federal`` by its number and year, ``state`` by
    its own number and year columns. Names without a number fall back to the code.
    """
    f = lambda c: field(df, c)
    name = F.coalesce(first_filled(f("apelido"), f("lei")), F.lit("Lei"))
    code = statute_code(name)
    if kind == "federal":
        code = F.coalesce(statute_number(f("lei"), "LF"), code)
    elif kind == "state":
        code = F.replace(F.concat(F.lit("SP"), f("numero"), F.lit("-"), f("ano")), F.lit(" "), F.lit(""))
    rows = df.where(F.length(f("texto")) >= least).select(name.alias("diploma"), code.alias("doc_id"), F.posexplode(articles(f("texto"), thousands=False)).alias("pos", "a"))
    rows = rows.select(F.concat_ws(":", "doc_id", F.lit("ART"), padded(F.col("a.number").cast("string"))).alias("id"), "doc_id", "diploma", F.col("a.number").alias("num_art"), F.substring("a.body", 1, 3000).alias("texto"), "pos", F.length("a.body").alias("n"))
    return first_n(rows.where(F.col("n") >= least_article), ["id"], [F.desc(F.length("texto")), "pos", "diploma", "texto"], 1).drop("pos", "n")


# Bulletins and search hits. The patterns are how the sources write process numbers, names and dates.

_PROCESS = r"(REsp|AREsp|HC|RHC|EREsp|AgRg|EDcl|MS|CC|Rcl|Pet|ARE|RE|ADI|ADPF)\s+[\d.,]+\s*/\s*[A-Z]{2}"


def note_fields(text: Column, old: bool = False) -> dict[str, Column]:
    """Process, rapporteur, body, day, theme and branch of a bulletin note; what is not found is empty."""
    caps, low = "A-ZÁÉÍÓÚÂÊÔÃÕÜ", "a-záéíóúâêôãõü"
    more = r"\s." if old else r"\s"
    rapporteur = rf"Rel\.?\s*(Ministr[ao])\s+([{caps}][{low}{more}]+?)(?:,|\.|Turma|Seção{'|' + chr(92) + 'n' if old else ''})"
    return {
        "processo": F.regexp_extract(text, _PROCESS, 0), "relator": F.trim(F.regexp_extract(text, rapporteur, 2)),
        "orgao": F.regexp_extract(text, r"(\d+[ªa]?\s*Turma|[12]ª?\s*Seção|Corte Especial|Terceira Seção|Primeira Seção|Segunda Seção)", 1),
        "data": F.regexp_extract(text, r"julgados?\s+em\s+([\d/]+)", 1), "tema_rep": F.regexp_extract(text, r"Tema\s+(\d+)", 1),
        "ramo": F.lit("") if old else F.trim(F.regexp_extract(F.substring(text, 1, 200), r"DIREITO\s+[A-ZÁÉÍÓÚÇÃ\s]+?(?=\.|$)", 0)),
    }


def bulletin_old(pages: DataFrame, number: str, text: str, least: int = 80) -> DataFrame:
    """Notes of plain-text bulletins: blocks that begin with a process number, with the fields found in them."""
    blocks = pages.select(number, F.posexplode(F.split(text, r"\n(?=(?:REsp|AREsp|HC|RHC|EREsp|MS|CC|Rcl)\s+[\d.,]+)")).alias("pos", "b"))
    blocks = blocks.select(number, "pos", F.trim("b", F.lit(" \n\t")).alias("b")).where(F.length("b") >= least)
    return blocks.select(number, "pos", *(c.alias(n) for n, c in note_fields(F.col("b"), old=True).items()), F.substring("b", 1, 2000).alias("texto"), F.length("b").alias("n_chars"))


def bulletin_new(rows: DataFrame, number: str, position: str, text: str, least: int = 100, least_head: int = 60) -> DataFrame:
    """Notes of bulletins in divisions: one row a division in page order; a division that opens with a process begins a group."""
    from pyspark.sql import Window

    starts = F.col(text).rlike(r"^Processo\s+(REsp|AREsp|HC|RHC|EREsp|AgRg|MS|CC|Rcl|Pet|ARE|RE)")
    grouped = rows.withColumn("__g", F.sum(starts.cast("int")).over(Window.partitionBy(number).orderBy(position))).where("__g > 0")
    notes = grouped.groupBy(number, "__g").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))).alias("x"))
    whole, head = F.trim(F.array_join(F.transform("x", lambda x: x["t"]), " ")), F.col("x")[0]["t"]
    notes = notes.select(number, F.col("__g").alias("note"), whole.alias("texto"), head.alias("__head")).where((F.length("texto") >= least) & (F.length("__head") >= least_head))
    return notes.select(number, "note", *(c.alias(n) for n, c in note_fields(F.col("__head")).items()), "texto", F.length("texto").alias("n_chars"))


def hit_text(df: DataFrame) -> Column:
    """The text of a search hit: its filled fields under their labels, in a fixed order."""
    head = F.when((field(df, "classe") != "") & (field(df, "numero") != ""), F.concat(F.lit("PROCESSO: "), field(df, "classe"), F.lit(" "), field(df, "numero")))
    parts = [F.when(field(df, n) != "", F.concat(F.lit(label), field(df, n))) for n, label in rules.HIT_LABELS]
    return F.concat_ws("\n\n", head, *parts)


def hit_records(df: DataFrame, least: int = 100) -> DataFrame:
    """Search hits as records; those whose text has fewer than ``least`` characters are left out."""
    rows = df.withColumn("__text", hit_text(df)).where(F.length("__text") >= least)
    f = lambda n: field(df, n)
    process = first_filled(f("processo"), F.concat_ws(" ", f("classe"), f("numero")))
    return rows.select(F.lit("stf_acordao").alias("fonte"), f("doc_id").alias("doc_id"), f("classe").alias("classe"), f("numero").alias("numero"), process.alias("processo"), f("relator").alias("relator"),
                       f("orgao").alias("orgao"), f("data").alias("data_julgamento"), f("tema").alias("tema_rg"), F.substring(f("ementa"), 1, 3000).alias("ementa"), F.substring("__text", 1, 10_000).alias("texto"), F.length("__text").alias("n_chars"))


def decision_fields(text: Column) -> dict[str, Column]:
    """Summary, rapporteur, day and body of a decision's page; what is not found is empty."""
    caps, low = "A-ZÁÉÍÓÚÂÊÔÃÕÜ", "a-záéíóúâêôãõü"
    return {
        "ementa": F.substring(F.trim(F.regexp_extract(text, r"(?isu)EMENTA[:\s]+(.*?)(?=ACÓRDÃO|RELATÓRIO|DECISÃO|$)", 1)), 1, 2000),
        "relator": F.trim(F.regexp_extract(text, rf"Relatora?\s*[:(]\s*([{caps}][{low}\s.]+?)(?:\n|,|\))", 1)),
        "data": F.regexp_extract(text, r"(?i)Julgado?\s+em\s+([\d/]+)", 1), "orgao": F.regexp_extract(text, r"(?iu)(Primeira Turma|Segunda Turma|Plenário|Tribunal Pleno)", 1),
    }


def chunk_records(docs: DataFrame, order: list[str], target: int = 5000) -> DataFrame:
    """Documents as chunk records: header, part mark and text, with ids made unique by the document's place in ``order``.

    Places come from written ranges, so no task holds all rows.
    """
    from corvane.functions.text import document_header, sentence_chunks
    from corvane.tables import numbered

    placed = numbered(docs.withColumn("__all", F.lit(0)), ["__all"], order, "__seq").withColumn("__seq", F.col("__seq") - 1)
    parts = placed.withColumn("__parts", sentence_chunks(F.col("texto"), target)).withColumn("n_chunks", F.size("__parts"))
    rows = parts.select("*", F.posexplode("__parts").alias("chunk_ix", "__part"))
    text = F.concat(document_header(), F.lit("\n[TEXTO — parte "), (F.col("chunk_ix") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit("]\n"), F.col("__part"))
    name = F.concat("id", F.lit("~"), F.col("__seq").cast("string"), F.lit("#"), F.col("chunk_ix").cast("string"))
    return rows.select(name.alias("id"), F.concat(F.lit("Jurisprudência bruta — "), "tribunal").alias("categoria"), F.lit("semi_bruto").alias("proveniencia"), F.col("fonte").alias("fonte_arquivo"),
                       first_filled(F.col("processo"), F.col("id")).alias("titulo"), F.lit("obra_publica_gov").alias("licenca"), F.lit("").alias("url"), "chunk_ix", "n_chunks", F.length(text).alias("n_chars"), text.alias("text"))
