"""Patterns and word lists that results depend on."""

UNITS = r"kg|g|mg|lb|t|m|cm|mm|km|mi|in|ft|V|kV|mV|A|mA|Hz|kHz|MHz|rpm|N\.?m|N·m|Pa|kPa|MPa|bar|psi|°C|°F|%"
URL = r"https?://\S+"
EMAIL = r"\b\w+@\w+\.[A-Za-z]{2,}\b"
DATE = r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b"
NUMBER = r"\b\d+(?:[\.,]\d+)?\b"
CODE = r"\b[A-Z]{2,}\d+\b"
QUANTITY = rf"\b\d+(?:[\.,]\d+)?\s?(?:{UNITS})\b"
LEADER_DOTS = r"(?:\.\s*){5,}"
ENTITIES = {
    "default": "|".join((URL, EMAIL, DATE, NUMBER, CODE, QUANTITY, LEADER_DOTS)),
    "relaxed": "|".join((URL, EMAIL, DATE, CODE, QUANTITY, LEADER_DOTS)),
}
TOKEN = r"(?i)ZXQ(?:ENT|GLOS)[A-Z0-9]*?X\d{4}ZXQ"
TOKEN_FUZZY = r"(?i)Z[XQ]{0,5}(ENT|GLOS)([A-Z0-9]{0,32}?)X?(\d{1,4})Z[XQ]{0,5}"
TOKEN_SPACED = r"(?i)Z\s*X\s*Q\s*(ENT|GLOS)\s*([A-Z0-9]{0,32}?)\s*X\s*0*(\d{1,4})\s*Z\s*X\s*Q"
LEAK = r"(?i)ZXQ|Z[XQ]{0,4}(?:ENT|GLOS)\w*\d"
BAD_MEMORY = r"(?i)ZXQ|__ENT_|__GLOS_"
SEGMENT = "ZXQSEGBOUNDARYZXQ"
GUARD_NUMBERS = rf"\b[+-]?\d+(?:[\.,]\d+)?\s?(?:{UNITS})?\b"
GUARD_REFERENCES = r"(?i)\b(?:fig\.?|figure|tabela|table)\s*\d+(?:[-–]\d+)?\b"
TOC_END = r"(?i)\s+(?:\d+|[ivxlcdm]+)\s*$"
SPACES = {"\u00a0": " ", "\u202f": " ", "\u2009": " "}
DASHES = {"\u2011": "-", "\u2212": "-"}
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st"}
PT_BR_NAMES = ("pb", "pt-br", "pt_br", "ptbr", "ptbrasil")
RETRY_WORDS = ("the", "and", "of", "to", "for", "with", "in", "on", "from", "by")
# (pattern, replacement) in order.
PT_BR_RULES = (
    (r"\bactualmente\b", "atualmente"), (r"\bactual\b", "atual"),
    (r"(?<!\bde\s)\bfactos\b", "fatos"), (r"(?<!\bde\s)\bfacto\b", "fato"),
    (r"\bequipas\b", "equipes"), (r"\bequipa\b", "equipe"),
    (r"\bprojectos\b", "projetos"), (r"\bprojecto\b", "projeto"),
    (r"\bobjectivos\b", "objetivos"), (r"\bobjectivo\b", "objetivo"),
    (r"\bobjectivas\b", "objetivas"), (r"\bobjectiva\b", "objetiva"),
    (r"\bactividades\b", "atividades"), (r"\bactividade\b", "atividade"),
    (r"\boptimiza", "otimiza"), (r"\boptimi", "otimi"),
    (r"\bcontactos\b", "contatos"), (r"\bcontacto\b", "contato"),
)
