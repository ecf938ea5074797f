"""Queries that build corpora: raw court tables to documents and cards, statutes to articles, bulletins and hits to records.

Raw tables are views of ``documents`` with the field names of the sources; texts are whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import selection
from corvane.plans.base import Registry, table
from corvane.sources import corpora

query = Registry()


def _digest(c):
    return F.md5(c.cast("binary"))


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _id():
    return F.col("doc_id").cast("string")


def _decisions(spark, d) -> DataFrame:
    """Raw decisions: some without a process number, some with the text None for a rapporteur."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("RE "), _id())).alias("processo"), F.concat(F.lit("D"), _id()).alias("id"), F.col("lang").alias("classe"), k.alias("numero"),
        F.when(k % 3 == 0, "None").otherwise(F.col("source")).alias("relator"), F.when(k % 3 == 0, "None").otherwise(F.col("source")).alias("relator_acordao_nome"), F.lit(None).cast("string").alias("orgao"),
        F.lit("2020-01-01").alias("data_julgamento"), F.when(k % 2 == 0, F.col("text")).alias("ementa"), F.col("text").alias("ementa_texto"), F.col("text").alias("texto"), (k % 900).alias("informativo"))


_RAW = ("r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'RE ' || doc_id END AS processo, 'D' || doc_id AS id, lang AS classe, CAST(doc_id AS VARCHAR) AS numero, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS relator, "
        f"{_squeezed('text')} AS t, doc_id % 2 = 0 AS even, text FROM documents)")


@query(f"WITH {_RAW} SELECT 'BRUTO:STF:' || CASE WHEN processo = '' THEN CAST(doc_id AS VARCHAR) ELSE processo END AS id, 'STF — acórdão' AS fonte, classe, numero, processo, relator, md5(CASE WHEN even THEN t ELSE '' END) AS ementa, md5(t) AS texto FROM r "
       "UNION ALL SELECT 'BRUTO:STF:CC:' || CASE WHEN processo = '' THEN id ELSE processo END, 'STF — controle concentrado', classe, numero, processo, relator, md5(t), md5(t) FROM r "
       "UNION ALL SELECT 'BRUTO:STJ:INFJ:' || (doc_id % 900) || ':' || doc_id, 'STJ — informativo', '', CAST(doc_id % 900 AS VARCHAR), CASE WHEN processo = '' THEN trim(regexp_extract(t, '((?:REsp|AREsp|HC|RHC|CC|MS|AgInt|EDcl)[\\s.\\d\\-/A-Z]{4,25})', 1)) ELSE processo END, relator, md5(''), md5(t) FROM r")
def raw_decisions(spark, d):
    r = _decisions(spark, d)
    docs = corpora.acordaos(r, r, r, "doc_id")
    return docs.select("id", "fonte", "classe", "numero", "processo", "relator", _digest(F.col("ementa")).alias("ementa"), _digest(F.col("texto")).alias("texto"))


def _precedents(spark, d) -> DataFrame:
    """Raw precedents: a third without a settled thesis, some without a theme number."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", _id().alias("numero"), F.when(k % 4 > 0, _id()).alias("tema"), _id().alias("numero_tema"), _id().alias("sumula_numero"), F.when(k % 3 > 0, F.col("text")).otherwise(" \n ").alias("tese"), F.col("lang").alias("titulo"), F.col("source").alias("descricao"),
        F.col("text").alias("sumula_texto"), F.col("text").alias("texto"), F.col("source").alias("nome_tema"), F.col("lang").alias("questao"), F.when(k % 7 > 0, "TJMG").alias("tribunal"), F.col("source").alias("orgao_julgador"), F.col("lang").alias("relator"),
        (k % 2 == 0).alias("is_vinculante"), F.col("source").alias("label"))


_PRE = f"r AS (SELECT *, CAST(doc_id AS VARCHAR) AS n, {_squeezed('text')} AS t FROM documents)"
_THESIS = "'[QUESTÃO] ' || {a} || ' ' || {b} || chr(10) || '[TESE FIXADA] ' || t"
_SETTLED = [
    ("'BRUTO:STF:SÚMULAVINCULANTE:' || n", "'STF — súmula vinculante'", "'STF'", "'Súmula Vinculante'", "t", "true"), ("'BRUTO:STF:SÚMULA:' || n", "'STF — súmula'", "'STF'", "'Súmula'", "t", "true"),
    ("'BRUTO:STJ:SUM:' || n", "'STJ — súmula'", "'STJ'", "'Súmula'", "t", "true"), ("'BRUTO:STJ:TEMA:' || n", "'STJ — tema repetitivo'", "'STJ'", "'Tema repetitivo'", "t", "doc_id % 3 > 0"),
    ("'BRUTO:STF:RG:' || n", "'STF — repercussão geral'", "'STF'", "'Tema de repercussão geral'", _squeezed("(" + _THESIS.format(a="lang", b="source") + ")"), "doc_id % 3 > 0 AND t <> ''"),
    ("'BRUTO:TJSP:SUM:' || n", "'TJSP — súmula'", "'TJSP'", "'Súmula'", "t", "true"),
    ("'BRUTO:IRDR:' || n", "'TJSP — IRDR'", "CASE WHEN doc_id % 7 > 0 THEN 'TJMG' ELSE 'TJSP' END", "'IRDR'", _squeezed("(" + _THESIS.format(a="source", b="lang") + ")"), "doc_id % 3 > 0 AND t <> ''"),
]


@query(f"WITH {_PRE}, x AS (" + " UNION ALL ".join(f"SELECT {i} AS id, {s} AS fonte, {c} AS tribunal, {k} AS classe, n AS numero, trim({k} || ' ' || n || ' do ' || {c}) AS processo, {t} AS texto FROM r WHERE {w}" for i, s, c, k, t, w in _SETTLED)
       + ") SELECT id, fonte, tribunal, classe, numero, processo, md5(texto) AS texto FROM x WHERE length(texto) >= 30")
def settled_precedents(spark, d):
    r = _precedents(spark, d)
    parts = [corpora.summaries(r, "STF", binding=True), corpora.summaries(r, "STF"), corpora.summaries(r, "STJ"), corpora.repetitive_themes(r), corpora.general_repercussion(r), corpora.summaries(r, "TJSP"),
             corpora.incidents(r, "IRDR", "TJSP — IRDR", "doc_id")]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("id", "fonte", "tribunal", "classe", "numero", "processo", _digest(F.col("texto")).alias("texto"))


def _csv_rows(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("conteudo"), F.when(k % 4 > 0, F.concat(_id(), F.lit("-10.2019.8.26"))).otherwise("").alias("nup"), F.concat(F.lit(" "), "lang").alias("classe"), F.col("source").alias("magistrado"),
        F.when(k % 2 == 0, F.col("source")).alias("orgao_julgador"), F.lit("1ª  Vara").alias("vara"), F.when(k % 3 > 0, "2020-02-03").alias("data_julgamento"), F.lit("2021-01-01").alias("data_publicacao"), F.col("text").alias("ementa"),
        F.when(k % 6 == 0, "Furto simples").when(k % 6 == 1, "Contratos bancários").when(k % 6 == 2, "ICMS").when(k % 6 == 3, "Pensão INSS").when(k % 6 == 4, "Licitação").otherwise("Nada").alias("assunto"), F.col("lang").alias("comarca"))


@query("WITH r AS (SELECT *, " + _squeezed("text") + " AS t, CASE WHEN doc_id % 4 > 0 THEN doc_id || '-10.2019.8.26' ELSE '' END AS nup FROM documents) SELECT 'BRUTO:TJSP:2_grau:' || CASE WHEN nup <> '' THEN nup ELSE CAST(doc_id AS VARCHAR) END AS id, 'TJSP — 2º grau' AS fonte, lang AS classe, "
       "CASE WHEN nup <> '' THEN nup ELSE lang || ' ' || doc_id END AS processo, CASE WHEN doc_id % 2 = 0 THEN source ELSE '1ª Vara' END AS orgao, CASE WHEN doc_id % 3 > 0 THEN '2020-02-03' ELSE '2021-01-01' END AS data, md5(t) AS texto FROM r WHERE length(t) >= 200")
def court_decisions(spark, d):
    out = corpora.court_csv(_csv_rows(spark, d), "2_grau", "doc_id")
    return out.select("id", "fonte", "classe", "processo", "orgao", "data", _digest(F.col("texto")).alias("texto"))


_PAD = "CASE WHEN length({0}) < 4 THEN lpad({0}, 4, '0') ELSE {0} END"
_CARDS = [
    ("'rg_stf'", "'JURIS:STF:RG:TEMA' || p", "'Tese de Repercussão Geral'", "'Vinculante (art. 927, III, CPC)'", "'Tema ' || n || ' — ' || lang || nn || 'Relator: ' || lang || nn || 'Descrição/Tese:' || chr(10) || source || nn || 'Título: ' || n", "doc_id % 4 > 0"),
    ("'temas_stj'", "'JURIS:STJ:REP:TEMA' || p", "'Tema Repetitivo'", "'Vinculante (art. 927, III, CPC)'", "'Tema Repetitivo STJ ' || n || ' — ' || lang || nn || 'Tese:' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN text ELSE ' ' || chr(10) || ' ' END || nn || 'Label: ' || source", "doc_id % 3 = 0 OR text <> ''"),
    ("'sumulas_stf'", "CASE WHEN doc_id % 2 = 0 THEN 'JURIS:STF:SUM:VINC:' ELSE 'JURIS:STF:SUM:' END || p", "CASE WHEN doc_id % 2 = 0 THEN 'Súmula Vinculante' ELSE 'Súmula' END", "CASE WHEN doc_id % 2 = 0 THEN 'Vinculante (art. 103-A CF)' ELSE 'Persuasivo' END",
     "CASE WHEN doc_id % 2 = 0 THEN 'Súmula Vinculante' ELSE 'Súmula' END || ' ' || n || ' — STF' || nn || lang || nn || 'Enunciado:' || chr(10) || text", "true"),
    ("'stj_acordaos'", "'JURIS:STJ:INFJ:' || lpad(CAST(doc_id % 900 AS VARCHAR), 4, '0') || ':' || CASE WHEN doc_id % 5 = 0 THEN right(sha256(text), 8) ELSE left(n, 10) END", "CASE WHEN doc_id % 5 = 0 THEN 'Nota de Informativo STJ' ELSE 'Acórdão STJ' END", "'Persuasivo'", "text", "length(text) > 150"),
    ("'stf_acordaos'", "'JURIS:STF:' || lang || ':' || n", "'Acórdão STF — ' || lang", "CASE WHEN lang = 'ADI' THEN 'Vinculante (efeito erga omnes)' ELSE 'Persuasivo' END", "left(text, 4000)", "length(text) > 300"),
]


@query("WITH r AS (SELECT doc_id, text, CASE WHEN lang = 'de' THEN 'ADI' ELSE lang END AS lang, source, CAST(doc_id AS VARCHAR) AS n, " + _PAD.format("CAST(doc_id AS VARCHAR)") + " AS p, chr(10) || chr(10) AS nn FROM documents) "
       + " UNION ALL ".join(f"SELECT {a} AS fonte, {i} AS juris_id, {t} AS tipo, {s} AS status_vinculante, md5({x}) AS documento FROM r WHERE {w}" for a, i, t, s, x, w in _CARDS))
def precedent_cards(spark, d):
    adi = lambda df, c: df.withColumn(c, F.when(F.col(c) == "de", "ADI").otherwise(F.col(c)))
    p = adi(adi(_precedents(spark, d), "titulo"), "relator")
    r = adi(_decisions(spark, d), "classe")
    parts = [corpora.repercussion_cards(p), corpora.theme_cards(p), corpora.summary_cards(p), corpora.note_cards(r), corpora.decision_cards(r)]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("fonte", "juris_id", "tipo", "status_vinculante", _digest(F.col("documento")).alias("documento"))


_AREA = ("CASE doc_id % 6 WHEN 0 THEN 'Direito Penal' WHEN 1 THEN 'Direito Civil' WHEN 2 THEN 'Direito Tributário' WHEN 3 THEN 'Direito Previdenciário' WHEN 4 THEN 'Direito Administrativo' ELSE 'Outras' END")


@query(f"WITH r AS (SELECT *, {_AREA} AS area, CASE doc_id % 6 WHEN 0 THEN 'Furto simples' WHEN 1 THEN 'Contratos bancários' WHEN 2 THEN 'ICMS' WHEN 3 THEN 'Pensão INSS' WHEN 4 THEN 'Licitação' ELSE 'Nada' END AS assunto FROM documents WHERE length(trim(text, ' ')) >= 100), "
       "s AS (SELECT * FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY area ORDER BY doc_id) <= 50) QUALIFY row_number() OVER (PARTITION BY area ORDER BY sha256('42|' || doc_id)) <= 10) "
       "SELECT 'CASE:TJSP:' || CASE WHEN doc_id % 4 > 0 THEN doc_id || '-102019826' ELSE left(md5(text), 12) END AS case_id, area, md5('Tribunal: TJSP | Classe:  ' || lang || ' | Assunto: ' || assunto || ' | Data julgamento: ' || CASE WHEN doc_id % 3 > 0 THEN '2020-02-03' ELSE '' END || chr(10) || chr(10) || 'Ementa:' || chr(10) || text || chr(10) || chr(10) || 'Conteúdo:' || chr(10) || left(text, 3000)) AS documento FROM s")
def case_cards(spark, d):
    out = corpora.case_cards(_csv_rows(spark, d), "TJSP", "doc_id", 10, first=50, least=100)
    return out.select("case_id", "area", _digest(F.col("documento")).alias("documento"))


_STATUTE = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 4 = 0 THEN 'Artigo ' || i || '° - o ' WHEN i % 7 = 3 THEN 'Art. 75-A. o ' ELSE 'Art. ' || i || 'º o ' END || l), chr(10))"
_HEAD = "(?m)(?:^|\\n)\\s*((?:Artigo|Art\\.?)\\s*\\d+[º°]?[\\s\\-–.]*(?:[A-Z]\\b)?[.\\-]?)\\s*"


@query(f"WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'Código Civil' WHEN doc_id % 3 = 1 THEN 'Lei ' || doc_id || '.099 / 1995' ELSE 'Estatuto da Cidade Nova' END AS lei, {_STATUTE} AS t FROM documents), "
       f"a AS (SELECT doc_id, lei, t, regexp_extract_all(t, '{_HEAD}', 1) AS h, regexp_split_to_array(t, '{_HEAD}')[2:] AS b FROM r WHERE length(t) >= 100), "
       "x AS (SELECT doc_id, lei, unnest(range(len(h))) AS pos, CAST(regexp_extract(unnest(h), '(\\d+)', 1) AS INTEGER) AS num, trim(unnest(h), ' ' || chr(10) || chr(9) || chr(13)) || ' ' || trim(unnest(b), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM a), "
       "y AS (SELECT *, trim(body) AS bt, CASE WHEN lei = 'Código Civil' THEN 'CC' WHEN lei LIKE 'Lei%' THEN 'LF' || replace(regexp_extract(lei, '(\\d[\\d.]*)\\s*/\\s*(\\d{4})', 1), '.', '') || '-1995' ELSE 'ECN' END AS code FROM x) "
       f"SELECT code || ':ART:' || {_PAD.format('CAST(num AS VARCHAR)')} AS id, num AS num_art, md5(left(bt, 3000)) AS texto FROM y WHERE length(bt) >= 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(left(bt, 3000)) DESC, pos, left(bt, 3000)) = 1")
def statute_articles(spark, d):
    """Documents as statutes: each line an article under one of three headings; of the articles of one id the longest stays."""
    def line(x, i):
        n = (i + 1).cast("string")
        return F.concat(F.when((i + 1) % 4 == 0, F.concat(F.lit("Artigo "), n, F.lit("° - o "))).when((i + 1) % 7 == 3, "Art. 75-A. o ").otherwise(F.concat(F.lit("Art. "), n, F.lit("º o "))), x)

    k = F.col("doc_id")
    laws = table(spark, d, "documents").select(
        F.when(k % 3 == 0, "Código Civil").when(k % 3 == 1, F.concat(F.lit("Lei "), _id(), F.lit(".099 / 1995"))).otherwise("Estatuto da Cidade Nova").alias("lei"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("texto"))
    return corpora.statute_articles(laws, "federal").select("id", "num_art", _digest(F.col("texto")).alias("texto"))


_CHUNKED = "list_reduce(list_transform(string_split(regexp_replace(t, '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {'done': CAST([] AS VARCHAR[]), 'cur': s}), lambda a, x: CASE WHEN a.cur = '' THEN {'done': a.done, 'cur': x.cur} WHEN length(a.cur) + 1 + length(x.cur) <= 1000 THEN {'done': a.done, 'cur': a.cur || ' ' || x.cur} ELSE {'done': list_append(a.done, a.cur), 'cur': x.cur} END)"


@query(f"WITH {_RAW}, p AS (SELECT *, 'BRUTO:STF:' || CASE WHEN processo = '' THEN CAST(doc_id AS VARCHAR) ELSE processo END AS bid, {_CHUNKED} AS s FROM r), c AS (SELECT *, CASE WHEN length(t) <= 1000 THEN [t] WHEN s.cur = '' THEN s.done ELSE list_append(s.done, s.cur) END AS c, row_number() OVER (ORDER BY bid) - 1 AS seq FROM p), "
       "h AS (SELECT *, CASE WHEN even AND t <> '' THEN left(t, 1200) WHEN strpos(reverse(left(t, 1200)), ' .') > 0 AND length(left(t, 1200)) - strpos(reverse(left(t, 1200)), ' .') - 1 > 300 THEN left(left(t, 1200), length(left(t, 1200)) - strpos(reverse(left(t, 1200)), ' .')) ELSE left(t, 1200) END AS sm FROM c), "
       "e AS (SELECT *, '<<JURIS|BRUTO|STF|' || CASE WHEN processo = '' THEN bid ELSE processo END || '>>' || chr(10) || '[DECISÃO] ' || CASE WHEN processo = '' THEN classe || ' ' || numero ELSE processo END || ' · STF' || CASE WHEN relator <> '' THEN ' · Rel. ' || relator ELSE '' END || ' · j. 2020-01-01' || chr(10) || '[RESUMO DA DECISÃO] ' || sm AS head, unnest(range(len(c))) AS ix, unnest(c) AS part FROM h) "
       "SELECT bid || '~' || seq || '#' || ix AS id, CAST(ix AS INTEGER) AS chunk_ix, CAST(len(c) AS INTEGER) AS n_chunks, md5(head || chr(10) || '[TEXTO — parte ' || (ix + 1) || '/' || len(c) || ']' || chr(10) || part) AS text FROM e")
def chunk_records(spark, d):
    docs = corpora.stf_decisions(_decisions(spark, d))
    return corpora.chunk_records(docs, ["id"], 1000).select("id", "chunk_ix", "n_chunks", _digest(F.col("text")).alias("text"))


# Bulletins, hits and fields found in texts.

_NOTE = "'REsp 1.' || doc_id || ' / SP' || chr(10) || 'Rel. Ministro Nome Sobrenome, Segunda Turma, julgado em 01/02/2020. Tema ' || doc_id || '. Corte Especial ' || text || chr(10) || 'HC 9.' || doc_id || '/RJ Rel Ministra Ana. julgados em 3/4/2021 ' || text"


@query(f"WITH p AS (SELECT doc_id, {_NOTE} AS t FROM documents), b AS (SELECT doc_id, string_split(regexp_replace(t, '\\n((?:REsp|AREsp|HC|RHC|EREsp|MS|CC|Rcl)\\s+[\\d.,]+)', chr(1) || '\\1', 'g'), chr(1)) AS b FROM p), "
       "x AS (SELECT doc_id, unnest(range(len(b))) AS pos, trim(unnest(b), ' ' || chr(10) || chr(9)) AS b FROM b) SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_extract(b, '(REsp|AREsp|HC|RHC|EREsp|AgRg|EDcl|MS|CC|Rcl|Pet|ARE|RE|ADI|ADPF)\\s+[\\d.,]+\\s*/\\s*[A-Z]{2}') AS processo, "
       "trim(regexp_extract(b, 'Rel\\.?\\s*(Ministr[ao])\\s+([A-ZÁÉÍÓÚÂÊÔÃÕÜ][a-záéíóúâêôãõü\\s.]+?)(?:,|\\.|Turma|Seção|\\n)', 2)) AS relator, regexp_extract(b, '(\\d+[ªa]?\\s*Turma|[12]ª?\\s*Seção|Corte Especial|Terceira Seção|Primeira Seção|Segunda Seção)', 1) AS orgao, "
       "regexp_extract(b, 'julgados?\\s+em\\s+([\\d/]+)', 1) AS data, regexp_extract(b, 'Tema\\s+(\\d+)', 1) AS tema_rep, md5(left(b, 2000)) AS texto, CAST(length(b) AS INTEGER) AS n_chars FROM x WHERE length(b) >= 80")
def bulletin_notes(spark, d):
    """Plain-text bulletins of two notes each."""
    t = F.concat(F.lit("REsp 1."), _id(), F.lit(" / SP\nRel. Ministro Nome Sobrenome, Segunda Turma, julgado em 01/02/2020. Tema "), _id(), F.lit(". Corte Especial "), "text", F.lit("\nHC 9."), _id(), F.lit("/RJ Rel Ministra Ana. julgados em 3/4/2021 "), "text")
    n = corpora.bulletin_old(table(spark, d, "documents").select("doc_id", t.alias("t")), "doc_id", "t")
    return n.select("doc_id", "pos", "processo", "relator", "orgao", "data", "tema_rep", _digest(F.col("texto")).alias("texto"), "n_chars")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM l), s AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 1 THEN 'Processo REsp 1.' || pos || '/SP, Rel. Ministro Luiz, Corte Especial, julgado em 1/2/2020 DIREITO PENAL. ' || line ELSE line END AS t FROM r), "
       "g AS (SELECT *, sum(CAST(pos % 3 = 1 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM s), n AS (SELECT doc_id, g, trim(string_agg(t, ' ' ORDER BY pos), ' ') AS texto, min_by(t, pos) AS head FROM g WHERE g > 0 GROUP BY ALL) "
       "SELECT doc_id, g AS note, 'REsp 1.' || (3 * g - 2) || '/SP' AS processo, 'Luiz' AS relator, 'Corte Especial' AS orgao, 'DIREITO PENAL' AS ramo, md5(texto) AS texto, CAST(length(texto) AS INTEGER) AS n_chars FROM n WHERE length(texto) >= 100 AND length(head) >= 60")
def bulletin_groups(spark, d):
    """Lines as divisions of a bulletin; every third opens a note."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("Processo REsp 1."), "pos", F.lit("/SP, Rel. Ministro Luiz, Corte Especial, julgado em 1/2/2020 DIREITO PENAL. "), "line")).otherwise(F.col("line"))
    n = corpora.bulletin_new(rows.withColumn("t", t), "doc_id", "pos", "t")
    return n.select("doc_id", "note", "processo", "relator", "orgao", "ramo", _digest(F.col("texto")).alias("texto"), "n_chars")


_HIT = "concat_ws(chr(10) || chr(10), 'PROCESSO: ' || lang || ' ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'RELATOR: ' || source END, 'DATA JULGAMENTO: 2020-01-01', CASE WHEN text <> '' THEN 'EMENTA:' || chr(10) || text END, CASE WHEN doc_id % 3 = 0 THEN 'TEMA:' || chr(10) || source END)"


@query(f"WITH h AS (SELECT *, {_HIT} AS t FROM documents) SELECT doc_id, lang || ' ' || doc_id AS processo, md5(left(t, 10000)) AS texto, CAST(length(t) AS INTEGER) AS n_chars FROM h WHERE length(t) >= 100")
def hit_records(spark, d):
    k = F.col("doc_id")
    hits = table(spark, d, "documents").select("doc_id", F.col("lang").alias("classe"), k.alias("numero"), F.when(k % 2 == 0, F.col("source")).alias("relator"), F.lit("2020-01-01").alias("data"), F.col("text").alias("ementa"), F.when(k % 3 == 0, F.col("source")).alias("tema"))
    return corpora.hit_records(hits).select(F.col("doc_id").cast("long").alias("doc_id"), "processo", _digest(F.col("texto")).alias("texto"), "n_chars")


@query("WITH p AS (SELECT doc_id, 'Relator: Fulano de tal, Segunda Turma' || chr(10) || 'julgado em 03/04/2021 EMENTA: ' || text || ' RELATÓRIO ' || text AS t FROM documents) SELECT doc_id, md5(left(trim(regexp_extract(t, '(?is)EMENTA[:\\s]+(.*?)(?:ACÓRDÃO|RELATÓRIO|DECISÃO|$)', 1), ' '), 2000)) AS ementa, "
       "'Fulano de tal' AS relator, '03/04/2021' AS data, 'Segunda Turma' AS orgao FROM p")
def decision_fields(spark, d):
    t = F.concat(F.lit("Relator: Fulano de tal, Segunda Turma\njulgado em 03/04/2021 EMENTA: "), "text", F.lit(" RELATÓRIO "), "text")
    f = corpora.decision_fields(t)
    return table(spark, d, "documents").select("doc_id", _digest(f["ementa"]).alias("ementa"), *(f[n].alias(n) for n in ("relator", "data", "orgao")))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'ADI' WHEN 2 THEN 'ADPF' WHEN 3 THEN 'RE' ELSE 'HC' END AS class, l_linenumber IN (1, 2) OR l_returnflag = 'R' AS binds FROM lineitem")
def binding_status(spark, d):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "ADI").when(n == 2, "ADPF").when(n == 3, "RE").otherwise("HC")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("class"), corpora.binding(kind, F.when(F.col("l_returnflag") == "R", True)).alias("binds"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'HC 12.345/SP' END AS given, CASE WHEN doc_id % 2 = 1 THEN 'HC 12.345/SP' ELSE 'REsp 1.2' || doc_id || '/RJ' END AS processo, right(sha256(text), 8) AS suffix, 'LF' || doc_id || '099-1995' AS code FROM documents")
def id_fallbacks(spark, d):
    """A process number found in the text where none is given, a stable suffix, a statute's number and year."""
    given = F.when(F.col("doc_id") % 2 == 0, "").otherwise("HC 12.345/SP")
    text = F.concat(F.lit("visto REsp 1.2"), _id(), F.lit("/RJ, "), "text")
    return table(spark, d, "documents").select("doc_id", given.alias("given"), X.process_number(given, text).alias("processo"), corpora.stable_suffix(F.col("text")).alias("suffix"), X.statute_number(F.concat(F.lit("Lei "), _id(), F.lit(".099/1995")), "LF").alias("code"))


@query("SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS n_tokens, count(*) AS n_docs FROM documents GROUP BY source")
def token_counts(spark, d):
    g = table(spark, d, "documents").groupBy("source")
    return g.agg(F.sum(X.token_count(F.col("text"))).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))


@query("SELECT doc_id FROM documents WHERE length(text) > 300 ORDER BY doc_id % 2 = 0 AND text <> '' DESC, n_chars DESC, doc_id LIMIT 40")
def ranked_decisions(spark, d):
    """Decisions with a summary first, then the longest."""
    r = table(spark, d, "documents").where(F.length("text") > 300)
    return selection.first_n(r.withColumn("all", F.lit(0)), ["all"], [((F.col("doc_id") % 2 == 0) & (F.col("text") != "")).desc(), F.desc("n_chars"), F.col("doc_id")], 40).select("doc_id")
