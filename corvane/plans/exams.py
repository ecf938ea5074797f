"""Queries over exam files: clean-up, classes and sections of pages, criteria, pairing, prompts and payloads.

Booklets and answer keys are made of documents, whole texts inside.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exams, rules
from corvane.functions import text as X
from corvane.operators import verdicts
from corvane.plans.base import Registry, table

query = Registry()


def _digest(c):
    return F.md5(c.cast("binary"))


def _id():
    return F.col("doc_id").cast("string")


_WS = "' ' || chr(10) || chr(9) || chr(13)"


def _list(phrases) -> str:
    return "[" + ", ".join("'" + p.lower().replace("'", "''") + "'" for p in phrases) + "]"


def _hits(text: str, phrases) -> str:
    return f"len(list_filter({_list(phrases)}, lambda p: contains(lower({text}), p)))"


_PAGE = ("'ORDEM DOS ADVOGADOS DO BRASIL' || chr(10) || lang || chr(10) || 'XX Exame de Ordem Unificado' || chr(10) || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'O fiscal de sala recolhe o rascunho.' ELSE 'Leia.' END || chr(10) || "
         "CASE WHEN doc_id % 3 = 0 THEN 'Q 1' || chr(10) || 'UESTÃO' ELSE 'QUESTÃO 1' END || chr(10) || text || chr(10) || 'QUESTÃO 1 – PÁGINA 3' || chr(10) || chr(10) || chr(10) || 'Padrão de Resposta ' || lang || ' Página 2 de 9'")


def _page():
    k = F.col("doc_id")
    return F.concat(F.lit("ORDEM DOS ADVOGADOS DO BRASIL\n"), "lang", F.lit("\nXX Exame de Ordem Unificado\n"), "source", F.lit("\n"), F.when(k % 2 == 0, "O fiscal de sala recolhe o rascunho.").otherwise("Leia."), F.lit("\n"),
                    F.when(k % 3 == 0, "Q 1\nUESTÃO").otherwise("QUESTÃO 1"), F.lit("\n"), "text", F.lit("\nQUESTÃO 1 – PÁGINA 3\n\n\nPadrão de Resposta "), "lang", F.lit(" Página 2 de 9"))


@query(f"WITH p AS (SELECT doc_id, {_PAGE} AS t FROM documents), a AS (SELECT doc_id, regexp_replace(t, '\\bQ\\s*(\\d+)\\s*\\n\\s*UEST[ÃA]O\\b', 'QUESTÃO \\1', 'g') AS t FROM p), "
       "b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)ORDEM DOS ADVOGADOS DO BRASIL\\n.*?Exame de Ordem Unificado\\n.*?\\n.*?\\n', '', 'g'), 'Padrão de Resposta.*?Página \\d+ de \\d+', '', 'g'), 'QUESTÃO \\d+ – PÁGINA \\d+', '', 'g') AS t FROM a), "
       f"c AS (SELECT doc_id, t, strpos(t, regexp_extract(t, '(?i)(QUEST[ÃA]O\\s+\\d+|PEÇA\\s+PRÁTICO|PEÇA\\s+JUR[ÍI]DICA)')) AS q FROM b), e AS (SELECT doc_id, CASE WHEN {_hits('left(t, q - 1)', rules.COVER_PHRASES)} >= 2 THEN substr(t, q) ELSE t END AS t FROM c) "
       f"SELECT doc_id, md5(trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS})) AS page FROM e")
def page_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", _digest(exams.clean_page(_page())).alias("page"))


_STATEMENT = "text || chr(10) || 'leve a caneta esferográfica' || chr(10) || 'ab' || chr(10) || chr(10) || chr(10) || chr(10) || 'o  examinando leva' || chr(10) || 'o examinando deve' || chr(10) || '• ' || lang || ' • ' || chr(10) || 'fim'"


@query(f"WITH s AS (SELECT doc_id, list_filter(string_split({_STATEMENT}, chr(10)), lambda l: trim(lower(l), {_WS}) = '' OR NOT ({_hits('l', rules.NOISE_PHRASES)} > 0 OR (length(trim(lower(l), {_WS})) < 10 AND regexp_matches(trim(lower(l), {_WS}), '^[•·\\-*]?\\s*[a-z]')) "
       "OR (regexp_matches(lower(l), 'examinando') AND NOT regexp_matches(lower(l), 'examinando\\s+deve')))) AS l FROM documents), j AS (SELECT doc_id, array_to_string(l, chr(10)) AS t FROM s) "
       f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\(cid:\\d+\\)', '', 'g'), '(?m)\\s*•\\s*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), {_WS})) AS statement FROM j")
def statement_cleanup(spark, d):
    t = F.concat("text", F.lit("\nleve a caneta esferográfica\nab\n\n\n\no  examinando leva\no examinando deve\n• "), "lang", F.lit(" • \nfim"))
    return table(spark, d, "documents").select("doc_id", _digest(exams.clean_statement(t)).alias("statement"))


_PAGE2 = "CASE doc_id % 4 WHEN 0 THEN array_to_string(list_transform(range(1, 61), lambda i: CAST(i AS VARCHAR)), chr(10)) || chr(10) || source WHEN 1 THEN 'Atenção: não será permitido portar aparelhos.' || chr(10) || text WHEN 2 THEN 'sua prova, informações gerais' || chr(10) || text ELSE 'sua prova, 5 (cinco) horas' || chr(10) || 'Questão 2' || chr(10) || text END"


@query(f"WITH p AS (SELECT doc_id, {_PAGE2} AS t FROM documents), l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS l, {_hits('t', rules.INSTRUCTION_PHRASES)} AS n FROM p) "
       "SELECT doc_id, len(l) < 3 OR len(list_filter(l, lambda x: regexp_matches(x, '^\\d+$'))) > 0.7 * len(l) AS writing, n >= 3 OR (n >= 2 AND NOT (regexp_matches(lower(t), 'quest[ãa]o\\s+\\d+\\b') OR regexp_matches(lower(t), '(?s)peça\\s+prático-profissional\\s*[\\n\\r].{200,}'))) AS instruction FROM l")
def page_classes(spark, d):
    k = F.col("doc_id") % 4
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string")), "\n")
    t = F.when(k == 0, F.concat(numbers, F.lit("\n"), "source")).when(k == 1, F.concat(F.lit("Atenção: não será permitido portar aparelhos.\n"), "text")).when(k == 2, F.concat(F.lit("sua prova, informações gerais\n"), "text")).otherwise(F.concat(F.lit("sua prova, 5 (cinco) horas\nQuestão 2\n"), "text"))
    return table(spark, d, "documents").select("doc_id", exams.is_writing_page(t).alias("writing"), exams.is_instruction_page(t).alias("instruction"))


#: An answer key in one of three layouts by document, whole texts inside.
_KEY = ("CASE doc_id % 3 WHEN 0 THEN 'PADRÃO DE RESPOSTA – PEÇA PROFISSIONAL' WHEN 1 THEN 'QUESTÃO: PEÇA PRÁTICO-PROFISSIONAL' ELSE 'PEÇA PRÁTICO-PROFISSIONAL' END || chr(10) || 'Gabarito Comentado' || chr(10) || text || chr(10) || 'Distribuição dos Pontos' || chr(10) || 'ITEM' || chr(10) || 'A. Item de ' || lang || ' (0,50)' || chr(10) || 'continua 0,00/0,10/0,45' || chr(10) || '0,00/0,20' || chr(10) || '5.1. Outro ' || source || chr(10) || "
        "CASE doc_id % 3 WHEN 0 THEN 'PADRÃO DE RESPOSTA – QUESTÃO 02' WHEN 1 THEN 'QUESTÃO: QUESTÃO DISCURSIVA' ELSE 'QUESTÃO 2' END || chr(10) || 'Enunciado' || chr(10) || text || chr(10) || 'Gabarito Comentado' || chr(10) || source || chr(10) || CASE WHEN doc_id % 3 = 1 THEN 'QUESTÃO: QUESTÃO DISCURSIVA' ELSE 'QUESTÃO 3' END || chr(10) || 'solto' || chr(10) || 'Enunciado' || chr(10) || lang")


def _keys(spark, d):
    k = F.col("doc_id") % 3
    one = F.when(k == 0, "PADRÃO DE RESPOSTA – PEÇA PROFISSIONAL").when(k == 1, "QUESTÃO: PEÇA PRÁTICO-PROFISSIONAL").otherwise("PEÇA PRÁTICO-PROFISSIONAL")
    two = F.when(k == 0, "PADRÃO DE RESPOSTA – QUESTÃO 02").when(k == 1, "QUESTÃO: QUESTÃO DISCURSIVA").otherwise("QUESTÃO 2")
    three = F.when(k == 1, "QUESTÃO: QUESTÃO DISCURSIVA").otherwise("QUESTÃO 3")
    text = F.concat(one, F.lit("\nGabarito Comentado\n"), "text", F.lit("\nDistribuição dos Pontos\nITEM\nA. Item de "), "lang", F.lit(" (0,50)\ncontinua 0,00/0,10/0,45\n0,00/0,20\n5.1. Outro "), "source", F.lit("\n"), two, F.lit("\nEnunciado\n"), "text",
                    F.lit("\nGabarito Comentado\n"), "source", F.lit("\n"), three, F.lit("\nsolto\nEnunciado\n"), "lang")
    return table(spark, d, "documents").select("doc_id", text.alias("t"))


_SECTIONS = (f"k AS (SELECT doc_id, list_filter(list_transform(string_split({_KEY}, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM k), "
             "m AS (SELECT *, regexp_matches(line, '(?i)PADRÃO DE RESPOSTA.*PEÇA') OR regexp_matches(line, '(?i)^((TIPO\\s+DE\\s+)?QUEST[ÃA]O\\s*:\\s*)?PEÇA PRÁTICO-PROFISSIONAL\\s*$') AS doc, regexp_matches(line, '(?i)^(TIPO\\s+DE\\s+)?QUEST[ÃA]O\\s*:\\s*QUEST[ÃA]O\\s+DISCURSIVA\\s*$') AS counted, "
             "coalesce(TRY_CAST(regexp_extract(line, '(?i)PADRÃO DE RESPOSTA.*QUESTÃO\\s+0?(\\d+)', 1) AS INTEGER), TRY_CAST(regexp_extract(line, '(?i)^QUESTÃO\\s+(\\d+)\\s*$', 1) AS INTEGER)) AS num, "
             "CASE WHEN regexp_matches(line, '(?i)^Gabarito Comentado\\s*$') THEN 'key' WHEN regexp_matches(line, '(?i)^Distribuição dos Pontos\\s*$') THEN 'points' WHEN regexp_matches(line, '(?i)^(Enunciado|ENUNCIADO DA QUESTÃO DISCURSIVA)\\s*$') THEN 'statement' END AS opened FROM e), "
             "s AS (SELECT *, doc OR counted OR num IS NOT NULL AS starts, sum(CAST(doc OR counted OR num IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS section, CASE WHEN counted THEN sum(CAST(counted AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) WHEN doc THEN NULL ELSE num END AS number FROM m), "
             "p AS (SELECT *, last_value(CASE WHEN NOT starts THEN opened END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM s), "
             "x AS (SELECT doc_id, section, CAST(max(number) AS INTEGER) AS number, " + ", ".join(f"coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT starts AND opened IS NULL AND part = '{n}'), '') AS {a}" for n, a in (("key", "answer"), ("points", "points"), ("statement", "statement")))
             + " FROM p GROUP BY doc_id, section), y AS (SELECT * FROM x WHERE answer <> '' OR points <> '') ")


@query(f"WITH {_SECTIONS} SELECT doc_id, CAST(section AS BIGINT) AS section, number, md5(answer) AS answer, md5(points) AS points, md5(statement) AS statement FROM y")
def answer_key_sections(spark, d):
    s = exams.answer_key_sections(_keys(spark, d), "doc_id", "t")
    return s.select("doc_id", "section", "number", *(_digest(F.col(c)).alias(c) for c in ("answer", "points", "statement")))


@query(f"WITH {_SECTIONS}, c AS (SELECT y.doc_id, section, lang, source FROM y JOIN documents d ON d.doc_id = y.doc_id WHERE points <> '') SELECT doc_id, CAST(1 AS BIGINT) AS place, 'A' AS criterion, 'Item de ' || lang || ' (0,50) continua' AS text, 0.5 AS points FROM c UNION ALL SELECT doc_id, 2, '5.1', 'Outro ' || source, 0.0 FROM c")
def point_criteria(spark, d):
    s = exams.answer_key_sections(_keys(spark, d), "doc_id", "t").where("points <> ''")
    return exams.criteria(s, ["doc_id", "section"], "points").drop("section")


_BOOK = "'capa' || chr(10) || 'PEÇA PRÁTICO-PROFISSIONAL' || chr(10) || text || chr(10) || 'QUESTÃO 1' || chr(10) || 'Diga ' || text || ' (Valor: 0,65)' || chr(10) || 'B) outra ' || lang || ' (Valor: 0,60)' || chr(10) || 'QUESTÃO 2' || chr(10) || source || ' (Valor: 0,00) e (Valor: 1,25)'"


def _booklets(spark, d):
    t = F.concat(F.lit("capa\nPEÇA PRÁTICO-PROFISSIONAL\n"), "text", F.lit("\nQUESTÃO 1\nDiga "), "text", F.lit(" (Valor: 0,65)\nB) outra "), "lang", F.lit(" (Valor: 0,60)\nQUESTÃO 2\n"), "source", F.lit(" (Valor: 0,00) e (Valor: 1,25)"))
    return table(spark, d, "documents").select("doc_id", t.alias("t"))


def _clean(t: str) -> str:
    keep = f"trim(lower(l), {_WS}) = '' OR NOT ({_hits('l', rules.NOISE_PHRASES)} > 0 OR (length(trim(lower(l), {_WS})) < 10 AND regexp_matches(trim(lower(l), {_WS}), '^[•·\\-*]?\\s*[a-z]')) OR (regexp_matches(lower(l), 'examinando') AND NOT regexp_matches(lower(l), 'examinando\\s+deve')))"
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split({t}, chr(10)), lambda l: {keep}), chr(10)), '\\(cid:\\d+\\)', '', 'g'), '(?m)\\s*•\\s*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), {_WS})"


_TRIM = "trim({0}, " + _WS + ")"


@query("WITH q AS (SELECT doc_id, 1 AS number, " + _TRIM.format("'Diga ' || text || ' (Valor: 0,65)' || chr(10) || 'B) outra ' || lang || ' (Valor: 0,60)'") + " AS body, " + _TRIM.format("'Diga ' || text || ' (Valor: 0,65)'") + " AS a, 'B) outra ' || lang || ' (Valor: 0,60)' AS b, 0.65 AS va, 0.60 AS vb FROM documents "
       "UNION ALL SELECT doc_id, 2, source || ' (Valor: 0,00) e (Valor: 1,25)', source || ' (Valor: 0,00) e (Valor: 1,25)', '', 1.25, 0.0 FROM documents) "
       f"SELECT doc_id, CAST(number AS INTEGER) AS number, md5({_clean('body')}) AS statement, md5({_clean('a')}) AS part_a, md5({_clean('b')}) AS part_b, CAST(va AS DOUBLE) AS value_a, CAST(vb AS DOUBLE) AS value_b FROM q")
def booklet_questions(spark, d):
    q = exams.booklet_questions(_booklets(spark, d), "doc_id", "t")
    return q.select("doc_id", "number", *(_digest(F.col(c)).alias(c) for c in ("statement", "part_a", "part_b")), "value_a", "value_b")


@query(f"SELECT doc_id, md5({_clean('trim(text, ' + _WS + ')')}) AS task FROM documents")
def document_tasks(spark, d):
    return _booklets(spark, d).select("doc_id", _digest(exams.document_task(F.col("t"))).alias("task"))


@query(f"WITH {_SECTIONS}, q AS (SELECT doc_id, 1 AS number, 'um' AS statement FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 2 = 0 THEN source END FROM documents) "
       "SELECT y.doc_id, y.number, md5(coalesce(nullif(q.statement, ''), nullif(y.statement, ''))) AS statement, md5(answer) AS answer FROM y LEFT JOIN q ON q.doc_id = y.doc_id AND q.number = y.number WHERE y.number IS NOT NULL AND coalesce(nullif(q.statement, ''), nullif(y.statement, '')) IS NOT NULL")
def paired_questions(spark, d):
    """Answer keys with the questions of a booklet that lacks every other statement, which the key then supplies."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    q = docs.select("doc_id", F.lit(1).alias("number"), F.lit("um").alias("statement")).unionByName(docs.select("doc_id", F.lit(2).alias("number"), F.when(k % 2 == 0, F.col("source")).alias("statement")))
    p = exams.paired_questions(q, exams.answer_key_sections(_keys(spark, d), "doc_id", "t"), ["doc_id"])
    return p.select("doc_id", "number", _digest(F.col("statement")).alias("statement"), _digest(F.col("answer")).alias("answer"))


_FILES = ("f AS (SELECT CAST(event_id % 400 AS BIGINT) AS exam, CASE CAST(user_id % 5 AS INTEGER) WHEN 0 THEN 'Direito-Penal' WHEN 1 THEN 'trabalhista' WHEN 2 THEN 'Civil' WHEN 3 THEN 'TRIBUTARIO' ELSE 'outra' END AS a, event_type AS e, event_id FROM events), "
          "n AS (SELECT exam, CASE e WHEN 'click' THEN 'Caderno-' || a || '-' || event_id WHEN 'view' THEN 'gabarito_def-' || a || '-' || event_id WHEN 'signup' THEN 'gabarito-prelim-2fase-' || a || '-' || event_id WHEN 'error' THEN 'gabarito_def-prelim-' || a || '-' || event_id ELSE 'edital-' || a END AS name, lower(a) AS la FROM f), "
          "x AS (SELECT exam, name, CASE WHEN contains(la, 'civil') THEN 'Direito Civil' WHEN contains(la, 'trabalh') THEN 'Direito do Trabalho' WHEN contains(la, 'penal') THEN 'Direito Penal' WHEN contains(la, 'tribut') THEN 'Direito Tributário' ELSE 'Desconhecida' END AS area, contains(lower(name), 'caderno') AS is_b, "
          "CASE WHEN contains(lower(name), 'gabarito_def') THEN CASE WHEN contains(name, 'prelim') THEN 1 ELSE 0 END WHEN contains(name, 'gabarito-prelim-2fase') THEN 2 END AS rank FROM n) ")


@query(f"WITH {_FILES}, b AS (SELECT exam, area, name AS booklet FROM x WHERE is_b QUALIFY row_number() OVER (PARTITION BY exam, area ORDER BY length(name), name) = 1), k AS (SELECT exam, area, name AS key FROM x WHERE rank IS NOT NULL AND NOT is_b QUALIFY row_number() OVER (PARTITION BY exam, area ORDER BY rank, name) = 1) SELECT exam, area, booklet, key FROM b JOIN k USING (exam, area)")
def exam_file_pairs(spark, d):
    u = F.col("user_id") % 5
    a = F.when(u == 0, "Direito-Penal").when(u == 1, "trabalhista").when(u == 2, "Civil").when(u == 3, "TRIBUTARIO").otherwise("outra")
    e = F.col("event_type")
    name = F.when(e == "click", F.concat_ws("-", F.lit("Caderno"), a, "event_id")).when(e == "view", F.concat_ws("-", F.lit("gabarito_def"), a, "event_id")).when(e == "signup", F.concat_ws("-", F.lit("gabarito-prelim-2fase"), a, "event_id")).when(
        e == "error", F.concat_ws("-", F.lit("gabarito_def-prelim"), a, "event_id")).otherwise(F.concat(F.lit("edital-"), a))
    files = table(spark, d, "events").select((F.col("event_id") % 400).alias("exam"), name.alias("name"))
    return exams.exam_files(files, "exam", "name")


@query("WITH f AS (SELECT event_id, CASE WHEN value > 90 THEN 'benchmark_exame' WHEN value > 20 THEN 'pdfs/exame' ELSE 'outros' END || (30 + user_id % 20) AS folder FROM events) SELECT event_id, CAST(regexp_extract(folder, 'exame(\\d+)', 1) AS INTEGER) AS exam FROM f WHERE regexp_matches(folder, 'exame\\d+') AND NOT contains(folder, 'benchmark') AND CAST(regexp_extract(folder, 'exame(\\d+)', 1) AS INTEGER) NOT IN (39, 40, 41)")
def training_exams(spark, d):
    v = F.col("value")
    folder = F.concat(F.when(v > 90, "benchmark_exame").when(v > 20, "pdfs/exame").otherwise("outros"), 30 + F.col("user_id") % 20)
    return exams.training_only(table(spark, d, "events").withColumn("folder", folder), "folder").select("event_id", "exam")


_TITLES = "CASE doc_id % 5 WHEN 0 THEN ' Endereçamento ' WHEN 1 THEN 'Peça' WHEN 2 THEN 'partes e Fundamento legal' WHEN 3 THEN source ELSE NULL END"


@query(f"WITH t AS (SELECT doc_id, {_TITLES} AS title, CASE doc_id % 4 WHEN 0 THEN ' Peça ' WHEN 1 THEN '' WHEN 2 THEN 'sentença' ELSE 'Parecer' END AS g, lang, source, text FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 'formal' ELSE 'merito' END AS class, CASE doc_id % 4 WHEN 0 THEN 'peca' WHEN 1 THEN 'discursiva' WHEN 2 THEN 'sentenca' ELSE 'parecer' END AS genre, "
       "CASE WHEN contains(lower(text), 'habeas corpus') THEN 'Habeas Corpus' WHEN contains(lower(text), 'embargos') THEN 'Embargos' WHEN doc_id % 2 = 0 THEN 'Agravo' ELSE 'Peça Processual' END AS kind, doc_id || '-disc-traba-' || (doc_id % 4) AS qid, "
       "CASE doc_id % 3 WHEN 0 THEN 'bloco IV · juris · semente 42 · Qwen' WHEN 1 THEN 'bloco 0 · bruto · semente 43 · t15' ELSE 'x_' || source END AS label, CASE WHEN doc_id % 2 = 0 THEN '+' || replace(printf('%.1f', doc_id / 8.0), '.', ',') ELSE '—' END AS shown FROM t")
def criterion_labels(spark, d):
    """Classes, genres, kinds, ids, condition labels and shown numbers."""
    k = F.col("doc_id")
    title = F.when(k % 5 == 0, " Endereçamento ").when(k % 5 == 1, "Peça").when(k % 5 == 2, "partes e Fundamento legal").when(k % 5 == 3, F.col("source"))
    genre = F.when(k % 4 == 0, " Peça ").when(k % 4 == 1, "").when(k % 4 == 2, "sentença").otherwise("Parecer")
    name = F.when(k % 3 == 0, "sft_iv_raw_s42_q8").when(k % 3 == 1, "ab_bruto_s43_t15").otherwise(F.concat(F.lit("x_"), "source"))
    return table(spark, d, "documents").select(
        "doc_id", X.criterion_class(title).alias("class"), X.genre(genre).alias("genre"), exams.document_type(F.concat("text", F.when(k % 2 == 0, " AGRAVO").otherwise(""))).alias("kind"), X.question_id(k, "disc", F.lit("Trabalhista"), k % 4).alias("qid"),
        X.condition_label(name, {"raw": "juris"}, {"q8": "Qwen"}).alias("label"), X.comma_number(F.when(k % 2 == 0, k / 8.0), 1, True).alias("shown"))


_SYS = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '" + rules.SYSTEM_PROMPTS[g].replace("'", "''") + "'" for i, g in enumerate(("peca", "discursiva", "sentenca"))) + " END"


@query(f"SELECT doc_id, md5({_SYS}) AS system, md5(trim(text, {_WS})) AS turn, CAST(2 AS INTEGER) AS n FROM documents")
def prompt_messages(spark, d):
    k = F.col("doc_id") % 3
    m = table(spark, d, "documents").select("doc_id", X.messages(F.when(k == 0, "practical").when(k == 1, "other").otherwise("sentença"), F.col("text")).alias("m"))
    return m.select("doc_id", _digest(F.col("m")[0]["content"]).alias("system"), _digest(F.col("m")[1]["content"]).alias("turn"), F.size("m").alias("n"))


@query("SELECT conv_id, md5('{\"messages\":[' || string_agg('{\"role\":\"' || role || '\",\"content\":' || to_json(text) || '}', ',' ORDER BY turn) || '],\"_meta\":{\"id\":\"casc-' || conv_id || '\",\"cascata\":true}}') AS line FROM conversations GROUP BY conv_id")
def message_lines(spark, d):
    """Conversations as JSON lines of messages and metadata."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    line = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.struct(F.concat(F.lit("casc-"), F.col("conv_id").cast("string")).alias("id"), F.lit(True).alias("cascata")).alias("_meta")))
    return c.select("conv_id", _digest(line).alias("line"))


_PAYLOAD = "CASE WHEN doc_id % 2 = 0 THEN '[{\"letra\":\"A\",\"parte\":\"1\",\"gabarito\":\"\",\"criterio\":' || to_json(text) || ',\"pontos\":0.5}]' ELSE '[{\"numero\":\"5.1\",\"parte\":\"1\",\"titulo\":' || to_json(source) || ',\"descricao\":' || to_json(text) || ',\"pontos\":0.5}]' END"


@query(f"SELECT doc_id, md5({_PAYLOAD}) AS payload FROM documents")
def judge_payload(spark, d):
    criteria = F.array(F.struct(F.lit("A").alias("letra"), F.lit("5.1").alias("numero"), F.lit("1").alias("parte"), F.lit(None).cast("string").alias("gabarito_item"), F.col("source").alias("titulo"), F.col("text").alias("texto"), F.lit(0.5).alias("pontuacao_max")))
    genre = F.when(F.col("doc_id") % 2 == 0, "discursiva").otherwise("peca")
    return table(spark, d, "documents").select("doc_id", _digest(verdicts.payload(criteria, genre)).alias("payload"))


@query("WITH p AS (SELECT doc_id, length('Questão:' || chr(10) || lang || chr(10) || chr(10) || 'Gabarito:' || chr(10) || source || chr(10) || chr(10) || 'Critério:' || chr(10) || c || chr(10) || chr(10) || 'Resposta:' || chr(10) || text || chr(10) || chr(10) || 'A resposta cumpre o critério? Responda SIM ou NÃO.') % 2 = 0 AS hit, w FROM documents, "
       "(VALUES ('um', 0.5), ('dois', 1.0), ('três', 0.25)) AS c(c, w)) SELECT doc_id, count(*) AS n_criteria, count(*) FILTER (WHERE hit) AS n_met, round(sum(CASE WHEN hit THEN w ELSE 0 END)::DOUBLE, 4) AS earned, 1.75::DOUBLE AS possible, round(sum(CASE WHEN hit THEN w ELSE 0 END)::DOUBLE / 1.75, 4) AS score FROM p GROUP BY doc_id")
def criterion_judging(spark, d):
    """A judge that says yes to prompts of even length, asked about each criterion of each document."""
    criteria = F.array(*(F.struct(F.lit(str(i)).alias("id"), F.lit(t).alias("texto"), F.lit(w).cast("double").alias("pontuacao_max")) for i, (t, w) in enumerate((("um", 0.5), ("dois", None), ("três", 0.25)))))
    docs = table(spark, d, "documents").withColumn("criteria", criteria)
    return verdicts.judge_criteria(docs, ["doc_id"], "lang", "text", "source", "criteria", chat=lambda prompt, system="": "SIM" if len(prompt) % 2 == 0 else "NÃO")


@query("WITH a AS (SELECT l_orderkey AS question, least(count(*), 2) AS n FROM lineitem GROUP BY 1), q AS (SELECT o_orderkey AS question, o_orderpriority AS p, coalesce(n, 0) AS n FROM orders LEFT JOIN a ON o_orderkey = question), r AS (SELECT question, p, unnest(range(n + 1, 5)) AS run FROM q) SELECT question, CAST(run AS INTEGER) AS run, reverse(p) AS answer, CAST(NULL AS VARCHAR) AS error FROM r")
def generated_answers(spark, d):
    """Four answers for each order, less those it has: numbered on from them."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("prompt"))
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n")).select("question", F.explode(F.array_repeat(F.lit("x"), F.col("n").cast("int"))).alias("answer"))
    return verdicts.generate(q, done, "question", "prompt", 4, chat=lambda prompt, system="": prompt[::-1])


@query("SELECT p_partkey, p_name || '!' AS expansion, 'upper' AS model, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_size > 10 OR p_size IN (2, 4)")
def expanded_items(spark, d):
    """Parts up to size ten are done, but for those whose expansion failed or was a stub."""
    p = table(spark, d, "part")
    done = p.where("p_size <= 10").select("p_partkey", F.when(F.col("p_size") == 2, None).when(F.col("p_size") == 4, "STUB:x").otherwise("card").alias("expansion"))
    return verdicts.expand(p, done, "p_partkey", "p_name", chat=lambda prompt, system="": prompt + "!", model="upper")


_ANSWER = "CASE doc_id % 4 WHEN 0 THEN '### CASO 1' || chr(10) || 'Excelentíssimo' WHEN 1 THEN 'Ao Juiz de ' || lang ELSE 'João de ' || lang END"


@query(f"WITH a AS (SELECT doc_id, {_ANSWER} AS enunciado, text FROM documents WHERE doc_id % 5 > 0) SELECT doc_id, enunciado, md5(text) AS resposta FROM a WHERE length(text) >= 500 AND doc_id % 4 >= 2")
def gated_answers(spark, d):
    """Answers as fenced JSON; every fifth is broken, some open like a pleading, some are short."""
    k = F.col("doc_id")
    said = F.when(k % 4 == 0, "### CASO 1\nExcelentíssimo").when(k % 4 == 1, F.concat(F.lit("Ao Juiz de "), "lang")).otherwise(F.concat(F.lit("João de "), "lang"))
    body = F.to_json(F.struct(said.alias("enunciado"), F.col("text").alias("resposta")))
    answer = F.when(k % 5 == 0, F.concat(F.lit("{broken "), "lang")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return verdicts.gated(table(spark, d, "documents").select("doc_id", answer.alias("a")), "a").select("doc_id", "enunciado", _digest(F.col("resposta")).alias("resposta"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0 AND conv_id % 2 = 0")
def nested_metadata(spark, d):
    """Predicates on a nested record."""
    c = table(spark, d, "conversations").withColumn("_meta", F.struct(F.when(F.col("conv_id") % 3 == 0, "1fase_transformada").otherwise("outra").alias("origem"), F.col("role").alias("tipo"), (F.col("conv_id") % 2 == 0).alias("ancorado")))
    return c.where("_meta.origem = '1fase_transformada' AND _meta.tipo = 'assistant' AND _meta.ancorado").select("conv_id", "turn")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS yes, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS annotated, doc_id % 2 = 0 AS truthy, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source || '-' || doc_id END AS key, 'QUESTÃO ' || doc_id AS heading, CAST(doc_id % 7 > 0 AS BOOLEAN) AS echoed FROM documents")
def answer_parsing(spark, d):
    """Yes and no, annotations, truth words, keys with a missing part, torn initials, echoed sums."""
    k = F.col("doc_id")
    said = F.when(k % 4 == 0, "**SIM**").when(k % 4 == 1, "não, nunca").when(k % 4 == 2, "ASSIM").otherwise("talvez")
    echo = verdicts.echo_ok(F.lit("tok"), k, F.lit(2), F.concat(F.lit("tok = "), F.when(k % 7 > 0, k + 2).otherwise(F.lit(-1)).cast("string")))
    return table(spark, d, "documents").select(
        "doc_id", X.yes_no(said).alias("yes"), X.starts_yes(F.when(k % 3 == 0, " Sim, mas").otherwise("Não")).alias("annotated"), X.truthy(F.when(k % 2 == 0, " true ").otherwise("2")).alias("truthy"),
        X.joined_key(F.when(k % 5 > 0, F.col("source")).otherwise(""), k).alias("key"), X.drop_cap(F.concat(F.lit("Q "), _id(), F.lit("\n UESTÃO"))).alias("heading"), echo.alias("echoed"))


@query("SELECT source, max(CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'x' END) IS NOT NULL AS some, md5(string_agg(doc_id || '=' || lang, ',' ORDER BY CAST(doc_id AS VARCHAR))) AS states FROM documents GROUP BY source")
def nested_states(spark, d):
    """Latest states as one map an outer key."""
    from corvane.sources import sinks

    docs = table(spark, d, "documents")
    n = sinks.nested(docs, "source", "doc_id", "lang")
    some = docs.groupBy("source").agg(F.bool_or(F.col("doc_id") % 2 == 1).alias("some"))
    pairs = F.array_sort(F.transform(F.map_entries("states"), lambda e: F.struct(e["key"].alias("k"), F.concat_ws("=", e["key"], e["value"]).alias("t"))))
    return n.select("source", _digest(F.array_join(F.transform(pairs, lambda p: p["t"]), ",")).alias("states")).join(some, "source")
