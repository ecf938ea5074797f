"""Word lists, labels and formats that results depend on. All are defaults; each function takes its own."""

# Areas of law by keyword, the first that matches.
AREA_KEYWORDS = [
    ("Direito Penal", ["crim", "penal", "tráfico", "furto", "roubo", "homicídio", "lesão"]),
    ("Direito Civil", ["civil", "contrat", "família", "inventário", "herança", "divórcio", "aliment"]),
    ("Direito do Trabalho", ["trabalho", "trabalhist", "CLT", "emprego", "rescisão", "FGTS"]),
    ("Direito do Consumidor", ["consum", "CDC", "produto", "serviço", "fornecedor"]),
    ("Direito Tributário", ["tribut", "imposto", "ICMS", "ISS", "IPTU", "fiscal"]),
    ("Direito Administrativo", ["admin", "licitação", "concurso", "servidor", "municipio", "estado"]),
    ("Direito Previdenciário", ["previd", "INSS", "aposentadoria", "benefício", "seguro"]),
]

# Area by a part of a file's name, the first that matches.
FILE_AREAS = [
    ("Direito Administrativo", ["administrativo"]),
    ("Direito Civil", ["civil"]),
    ("Direito Constitucional", ["constitucional"]),
    ("Direito do Trabalho", ["trabalho", "trabalhista"]),
    ("Direito Empresarial", ["empresarial"]),
    ("Direito Penal", ["penal"]),
    ("Direito Tributário", ["tribut", "tributario", "tributário"]),
]

# Kind of a procedural document by a phrase of its answer key, the first that matches.
DOCUMENT_TYPES = [
    ("Mandado de Segurança", ["mandado de segurança"]),
    ("Habeas Corpus", ["habeas corpus"]),
    ("Recurso de Apelação", ["apelação", "recurso de apelação"]),
    ("ADI", ["ação direta de inconstitucionalidade"]),
    ("Ação Civil Pública", ["ação civil pública"]),
    ("Ação Popular", ["ação popular"]),
    ("Mandado de Injunção", ["mandado de injunção"]),
    ("Recurso Especial", ["recurso especial"]),
    ("Embargos", ["embargos"]),
    ("Contestação", ["contestação"]),
    ("Agravo", ["agravo"]),
]

# Criterion titles that ask for form, not for merit.
FORMAL_TITLES = [
    "endereçamento", "fechamento", "encerramento", "interposição", "tempestividade",
    "qualificação das partes", "qualificação dos interessados/ requerentes", "partes",
    "peça", "petição de interposição", "prazo e fechamento", "valor da causa / fechamento",
    "menção ao valor da causa", "procedimento", "requisitos de admissibilidade recursal",
    "requisitos tempestividade", "honorários advocatícios",
    "gratuidade de justiça e prioridade", "partes e fundamento legal",
]

# Canonical codes of statutes by a part of the name, the first that matches.
STATUTE_CODES = [
    ("CF88", "CF88"), ("Código Civil", "CC"), ("Código Penal", "CP"), ("Código de Processo Civil", "CPC"),
    ("Código de Processo Penal", "CPP"), ("CLT", "CLT"), ("Código de Defesa do Consumidor", "CDC"),
    ("Código Tributário Nacional", "CTN"), ("Código Eleitoral", "CE"), ("Código Florestal", "CFLO"),
    ("ECA", "ECA"), ("Estatuto da OAB", "EOAB"),
]

# Names of genres that mean another.
GENRE_ALIAS = {
    "dissertacao": "discursiva", "dissertação": "discursiva", "discursive": "discursiva", "peça": "peca",
    "document_writing": "peca", "practical": "peca", "sentença": "sentenca",
}

# Short codes of areas in question ids.
AREA_CODES = {
    "administrativo": "admin", "civil": "civil", "constitucional": "const", "empresarial": "empre", "penal": "penal",
    "trabalhista": "traba", "tributário": "tribu", "tributario": "tribu",
}

# Classes of action whose decisions bind.
BINDING_CLASSES = ["ADI", "ADPF", "ADC", "ADO"]

# Exams kept for evaluation.
EVALUATION_EXAMS = [39, 40, 41]

# Phrases of a booklet's cover that remove all before the first question, if two of them occur there.
COVER_PHRASES = [
    "fiscal de sala", "fiscal da sala", "caderno para transcrição", "caderno de textos definitivos",
    "FGV realizará identificação", "identificação datiloscópica", "NÃO SERÁ PERMITIDO", "Confira seus dados pessoais",
    "5 (cinco) horas é o tempo", "tempo disponível para a realização", "será possível retirar-se da sala", "rascunho",
    "Assinale seu nome", "caneta esferográfica transparente",
]

# Phrases that mark a page of instructions.
INSTRUCTION_PHRASES = [
    "sua prova", "informações gerais", "fiscal de sala", "fiscal da sala", "não será permitido", "caneta esferográfica",
    "caderno de textos definitivos", "fgv realizará identificação", "identificação datiloscópica", "5 (cinco) horas",
    "2 (duas) horas", "tempo disponível para a realização", "termo desistindo", "portar aparelhos", "agenda eletrônica",
    "controle de alarme", "atenção", "elaboração dos textos", "incluir todos os dados",
]

# Phrases that mark a line of a statement as left over from the cover.
NOISE_PHRASES = [
    "fiscal da sala", "fiscal de sala", "fiscal de aplicação", "caderno de textos definitivos",
    "caderno para transcrição", "caderno de rascunho", "será possível retirar-se", "caneta esferográfica",
    "fgv realizará identificação", "identificação datiloscópica", "lista de presença", "tempo disponível para a realização",
    "agenda eletrônica", "telefone celular", "máquina fotográfica", "walkman", "controle de alarme", "pendrive",
    "examinandos por meio da coleta", "impressões digitais", "qualquer tipo de comunicação", "levantar da cadeira",
    "termo desistindo", "portar aparelhos", "horário de realização", "padrão de resposta", "(cid:", "página", "XXXIII",
    "XXXIV", "XXXV", "exame de ordem unificado", "prova prático", "verifique se a disciplina",
    "ordem dos advogados do brasil",
]

# Forms of address that open a pleading, so a statement that begins so is not a case.
PLEADING_OPENING = (r"(?iu)^[^\p{L}\p{N}_]*(?:EXCELENT[ÍI]SSIM|EXMO|EXMA|ILUSTR[ÍI]SSIM|AO\s+(?:JU[ÍI]Z|MM|EXMO)|MERIT[ÍI]SSIM|"
                    r"SENHOR\s+(?:DOUTOR\s+)?(?:JU[ÍI]Z|DESEMBARGADOR|MINISTRO|PRESIDENTE))")

# Instructions to the model by genre.
SYSTEM_PROMPTS = {
    "discursiva": "Você é um advogado especialista respondendo questões discursivas da OAB 2ª fase.\n"
                  "REGRAS: prosa técnica corrida, SEM Markdown (nunca ** ou ##), SEM placeholders "
                  "entre colchetes, SEM cabeçalhos numerados; cite dispositivos legais inline "
                  "(ex: 'conforme o art. 5º da CF').",
    "peca": "Você é um advogado experiente redigindo peças jurídicas para a OAB 2ª fase.\n"
            "REGRAS: estrutura formal (endereçamento, qualificação, fatos, direito, pedidos, "
            "fecho); TEXTO PURO, SEM Markdown (sem ** ou ##); endereçamento e títulos de seção "
            "em CAIXA ALTA; pedidos em alíneas a) b) c).\n"
            "PROIBIDO deixar lacuna para preencher: nada de [Nome do Advogado], [Cidade], "
            "[Data], [OAB/UF nº], linha pontilhada ou XXX. A peça sai PRONTA — invente nome, "
            "cidade, data e número de inscrição plausíveis e escreva-os por extenso.",
    "parecer": "Você é advogado público redigindo parecer jurídico para consulta da administração.\n"
               "REGRAS: relatório da consulta, análise jurídica fundamentada e conclusão objetiva; "
               "TEXTO PURO, SEM Markdown, SEM placeholders entre colchetes.",
    "sentenca": "Você é magistrado redigindo sentença.\n"
                "REGRAS: relatório, fundamentação e dispositivo; TEXTO PURO, SEM Markdown, "
                "SEM placeholders entre colchetes.",
}

# Labels of the parts of a record assembled from a search hit, in order.
HIT_LABELS = [
    ("relator", "RELATOR: "), ("orgao", "ÓRGÃO: "), ("data", "DATA JULGAMENTO: "), ("partes", "PARTES:\n"), ("ementa", "EMENTA:\n"),
    ("ata", "ACÓRDÃO:\n"), ("tese", "TESE:\n"), ("tema", "TEMA:\n"), ("legislacao", "LEGISLAÇÃO CITADA:\n"),
    ("indexacao", "INDEXAÇÃO:\n"), ("observacao", "OBSERVAÇÕES:\n"), ("url", "INTEIRO TEOR URL: "),
]
