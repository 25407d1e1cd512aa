"""Fixed values of the domain: words, units, ranges, categories. All of them must equal the published rules."""

GENERIC_WORDS = (
    "de do da dos das para com em nova novo existente existentes conforme especificacao especificacoes projeto "
    "instalacao execucao fornecimento fornecida tipo tipos cor modelo padrao altura comprimento largura espessura "
    "ceramico ceramica ceramicos ceramicas metalico metalica plastico plastica area areas m2 m un ml"
).split()
KEY_SEPARATORS = (" - ", " — ", " / ", " departamento ", " deptos ", " do depto ", " da sala ", " sala ", " para sala ")
VARIANT_SEPARATORS = (" - ", " — ", " departamento ", " deptos ", " da sala ")
SEARCH_STOP_WORDS = "de do da em com para tipo modelo novo nova existente conforme execucao fornecimento instalacao".split()

# Fixed value: an object with objects one level deep, as answers are searched for one.
NESTED_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
# Fixed value: format codes of drawing text (font, colour, lines, paragraph, stacking and sizes, hard blank, braces).
MTEXT_CODES = r"\\[fF][^;]*;|\\[cC][0-9]+;|\\[LlOoKk]|\\[Pp]|\\[SsQqHhWwTt][^;]*;|\\~|[{}]"
# Fixed value: what parts the words of a layer or block name.
NAME_SEPARATORS = r"[-_\s./\\|:]+"
# What is said of a discipline in a unit that doesn't suit it.
MISMATCH_REASONS = {
    ("Iluminação", "m²"): "luminárias se contam em 'un', não em área", ("Iluminação", "m"): "luminárias se contam em 'un', não em metros",
    ("Pisos e Rodapés", "un"): "piso é superfície, deve ser m² — exceção: elementos pontuais como grelhas", ("Forros", "un"): "forro é superfície, deve ser m²",
    ("Ar-Condicionado", "m²"): "equipamentos de AC são unidades, não área", ("Incêndio e Segurança", "m²"): "sprinklers/detectores são unidades", ("Portas e Ferragens", "m²"): "portas são unidades, não área",
}

# Names of lengths and areas by category, others are the prefix and the category.
LENGTH_NAMES = ("Comprimento linear — ", {"paredes": "Parede drywall nova", "demolicao": "Demolição de parede existente"})
AREA_NAMES = ("Área — ", {"pintura": "Pintura (área hachurada)", "piso": "Piso (área hachurada)", "forro": "Forro (área hachurada)"})

FIXED_UNITS = ("vb", "%", "mês", "mes", "dia", "h")
COUNT_WORDS = (
    "lumin[áa]rias?|spots?|projetores?|pendentes?|arandelas?|portas?|janelas?|esquadrias?|tomadas?|interruptores?|sensores?|"
    "difusores?|grelhas?|sprinklers?|detectores?|c[âa]meras?|cftv|quadro|qdf|caixa(?:\\s+de\\s+som)?|al[çc]ap[ãa]o|al[çc]ap[õo]es|chuveiros?|torneiras?"
)
LINEAR_WORDS = "rodap[eé]s?|tabicas?|soleiras?|perfi(?:l|s)|perfilados?|molduras?|eletrocalhas?|eletrodutos?|trilhos?|cord[aã]o|cord[õo]es|cornijas?"
SURFACE_WORDS = "pisos?|forros?|pinturas?|revestimentos?|azulejos?|cer[âa]micas?|porcelanatos?|carpetes?|viníl|vinílicos?|tapetes?"
UNIT_PRIORITY = ("un", "ml", "m²", "m", "vb")
#: unit: (least, most) plausible quantity
UNIT_RANGES = {"un": (0, 5000), "ml": (0, 50000), "m²": (0, 50000), "m": (0, 50000), "mês": (0, 60), "dia": (0, 1000), "%": (0, 100), "vb": (0, 1)}
UNIT_MISMATCHES = (("Iluminação", "m²"), ("Iluminação", "m"), ("Pisos e Rodapés", "un"), ("Forros", "un"), ("Ar-Condicionado", "m²"), ("Incêndio e Segurança", "m²"), ("Portas e Ferragens", "m²"))
CONFIDENCES = ("confirmado", "estimado", "verificar")
DISCIPLINES = (
    "Serviços Preliminares", "Demolição e Remoção", "Fechamentos Verticais", "Revestimentos", "Pisos e Rodapés", "Forros", "Portas e Ferragens", "Divisórias e Vidros",
    "Persianas e Cortinas", "Iluminação", "Instalações Elétricas e Dados", "Ar-Condicionado", "Incêndio e Segurança", "Marcenaria", "Mobiliário", "Complementares",
)
TYPOLOGY_DEFAULT = "office"

SHEET_PATTERNS = (
    ("demolir", "demolir|demoli|100\\."), ("layout_novo", "layout\\s*novo|200\\."), ("layout_atual", "layout\\s*atual|201\\."), ("mobiliario", "mobili|300\\."),
    ("marcenaria", "marcenaria|301\\."), ("arquitetura", "arquitetura|400\\."), ("pontos", "pontos|500\\."), ("piso", "piso|600\\."),
    ("forro", "forro\\.?\\d*-|forro.*00|700\\."), ("det_forro", "det\\s*forro|701\\."),
)
SHEET_PRIORITY = {"layout_novo": 0, "layout_atual": 1, "demolir": 2, "arquitetura": 3, "forro": 4, "piso": 5, "pontos": 6, "mobiliario": 7, "marcenaria": 8, "det_forro": 9}

#: category: first letters of layer or block name tokens
CATEGORIES = {
    "luminarias": "LUM LUMI LUMINARIA ILUM ILU LIGHT LT LGT", "paredes": "PAR PARED PAREDE WALL DRY DRYWALL GESS GYP DIV DVR", "forro": "FOR FORR FORRO CEIL TET TETO",
    "piso": "PIS PISO FLOOR FLR FLOR PAV CARPE CARPET RODA RODAP SKIRT", "portas": "PORT PORTA PRT DOOR DR", "incendio": "SPK SPRINK SPRINKLER INC INCEND INCENDIO FIRE PPCI",
    "eletrica": "ELET ELETR ELE ELEC POWR POWER TOMAD TOM TOMADA INTER CIRC", "ar_condicionado": "HVAC COND CLIMA DUTO DIFUS FRIG EVAP SPLIT CHILL ARCOND",
    "dados": "DAD DADOS DATA REDE LOG VOIP RJ CAT6 WIFI ACCESS", "demolicao": "DEM DEMOL DEMO DEMOLIR", "pintura": "PINT PINTURA PAINT PNT",
}
CATEGORY_DISCIPLINE = {
    "luminarias": "Iluminação", "paredes": "Fechamentos Verticais", "forro": "Forros", "piso": "Pisos e Rodapés", "portas": "Portas e Ferragens", "incendio": "Prevenção e Combate a Incêndio",
    "eletrica": "Instalações Elétricas", "ar_condicionado": "Ar-Condicionado", "dados": "Instalações Elétricas e Dados", "demolicao": "Demolição e Remoção", "pintura": "Revestimentos",
}
OPENING_PATTERN = "PORT|PRT|DOOR|JANE|JN|JAN|ESQU|ESQ-|VIDRO|GLASS|WIN|^(PM|PJ|PD|JN|JL|J[0-9]|P[0-9])"
UTILITY_LAYERS = ("DEFPOINTS", "0-DEFPOINTS", "DEFPOINTS_NO_PLOT", "VIEWPORTS", "VIEWPORT", "VP", "_GRADE", "GRADE", "GRID")
ANNOTATION_PATTERN = "^(ANNO|ANNOTATION|NOTE|NOTES|LEG|LEGEND|LEGENDA|TAG|SECTION|ELEVATION|DETAIL|DET|ARROW|CALLOUT|NORTH|NORTE|ROSA_DOS_VENTOS|TITLE|TITLEBLOCK|CARIMBO|REVISION|REVISAO|ADCADD|FORMA|FORM|NIVEL|NIV|LEVEL|CHNIVP|CHNIV|CHNIVEL|AREA[0-9])([\\s_-]|$)"
XREF_PATTERN = "\\.(dwg|dxf)$|\\.xref|^xref"
ANNOTATION_NAMES = ("CHNIVP", "CHNIV", "CHNIVEL", "INDNORTE", "INDNIVEL", "INDCORTE", "INDETALHE")
#: drawing unit code: metres
UNIT_METRES = {1: 0.0254, 2: 0.3048, 3: 1609.344, 4: 0.001, 5: 0.01, 6: 1.0, 7: 1000.0, 8: 0.0000254, 9: 0.001, 10: 0.9144, 11: 1.0e-10, 12: 1.0e-9, 13: 1.0e-6, 14: 0.1}

CONTINGENCY, BDI = 0.10, 0.275
PRICE_LEAST, PRICE_SHEET = 9700, 2000

# Units that a history row may have, words of heading and total rows.
HISTORY_UNITS = ("m", "m2", "m²", "un", "ml", "pc", "kg", "l", "h", "dia", "vb")
HISTORY_HEADINGS = ("total geral", "subtotal", "soma", "resumo", "descrição", "descricao", "item", "discriminação")

# Names of the catalog's levels in alerts, and the texts of an alert (placeholders: density, unit, factor, level, mean, deviation, projects).
LEVEL_LABELS = {"familia": "família", "grupo": "grupo", "capitulo": "capítulo"}
ALERT_TEXT = "densidade %s %s/m² é %s× %s que o típico (nível %s: %s ± %s, n=%s projetos) — possível %s"
ALERT_WORDS = {"high": ("maior", "dupla contagem"), "low": ("menor", "subcontagem")}
ALERT_NOTE = " | ⚠ Calibração: "
