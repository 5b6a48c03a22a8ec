"""Text normalisers as column expressions. Each serves one stage; they differ on purpose and are not to be merged."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with marks (Latin-1 to Latin Extended Additional) and the letters they come from, built from Unicode.
_PAIRS = {chr(c): d for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}
_FROM, _TO = "".join(_PAIRS), "".join(_PAIRS.values())
#: Combining marks that a decomposed text carries by themselves.
_MARKS = r"[̀-ͯ]"

#: Words that say nothing about who was paid.
STOP_WORDS = (
    "pix enviado enviada recebido recebida ted doc pagto pgto pag pagamento pago compra compras debito credito transferencia cartao boleto "
    "ltda me mei eireli sa s a banco agencia conta aut auto automatico de da do das dos online www com br"
).split()
#: Forms of a word that count as one.
EQUIVALENT = {"servicos": "servico", "sistemas": "sistema", "seguros": "seguro", "pecas": "peca", "empresas": "empresa", "empresarial": "empresa"}
#: Tokens that many payees share.
GENERIC_TOKENS = (
    "pagamento pagto pgto pix ted doc boleto debito credito transferencia servico digital sistema software gestao empresa comercio comercial loja "
    "equipamento marketplace mercado internet telefone telefonia taxa fatura conta parcela peca posto restaurante pizzaria farmacia drogaria material "
    "escritorio suprimento logistica pedido lote modulo plano mensalidade assinatura fornecedor cliente inc corp corporacao base usage api"
).split()
#: Groups of words that mean one kind of payment.
ALIAS_GROUPS = {
    "rent": "aluguel locacao imobiliaria", "energy": "energia eletrica luz enel cemig light copel celesc neoenergia", "telecom": "internet telefone telefonia vivo claro tim oi",
    "streaming": "netflix spotify deezer youtube primevideo", "software": "google microsoft aws azure adobe saas", "insurance": "seguro seguros seguradora",
    "payroll": "salario folha prolabore", "commission": "comissao", "taxes": "imposto darf simples",
}
#: Tokens left out when suggestions are consolidated.
NOISE_TOKENS = (
    "ajuste auto comp cred credito deb debito doc lancto nf pag pagamento pagto parc parcela pix receb recebimento ref syn sintet sintetico ted transf transferencia"
).split()


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), _MARKS, "")


def _with(value: Column, of) -> Column:
    """``of(value)``, which computes ``value`` once however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _undated(t: Column) -> Column:
    """Text without dates and codes. The three longer forms of a date all hold what the first pattern looks for; replaced
    parts are blanks, which no pattern goes across, so looking once is enough."""
    dates = (r"\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b", r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\b", r"\b[0-9]{1,2}[-/.][0-9]{4}\b")
    long = t
    for dated in dates:
        long = F.regexp_replace(long, dated, " ")
    t = F.when(t.rlike(r"[0-9]{4}[-/.][0-9]|[-/.][0-9]{1,2}[-/.][0-9]{2}|[-/.][0-9]{4}"), long).otherwise(t)
    return F.regexp_replace(F.regexp_replace(t, r"\b[0-9]{1,2}[-/.][0-9]{1,2}\b", " "), r"\b[0-9]{6,}\b", " ")


def recurrence_tokens(text: Column) -> Column:
    """N1: distinct lower-case tokens in order, without dates, codes, digits, short tokens and stop words."""
    same = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])

    def split(t: Column) -> Column:
        t = F.when(t.contains("s/a"), F.regexp_replace(t, r"\bs/a\b", " sa ")).otherwise(t)
        return F.split(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), " ")

    # Plain ASCII has no accents to look for.
    plain = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(strip_accents(t))
    words = _with(_with(_with(F.lower(F.coalesce(text, F.lit(""))), plain), _undated), split)
    tokens = F.transform(words, lambda w: F.coalesce(F.element_at(same, w), w))
    keep = F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]") & ~w.isin(STOP_WORDS))
    return F.array_distinct(keep)


def rule_text(text: Column) -> Column:
    """N2: upper case without accents; anything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(text)), r"[^\p{L}\p{N}]+", " "))


def pair_text(text: Column) -> Column:
    """N3: as N2, with null as empty."""
    return F.coalesce(rule_text(text), F.lit(""))


def repaired(text: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, when that leaves fewer suspicious characters."""
    odd = F.lit(r"[\x{C2}\x{C3}\x{FFFD}\x{80}-\x{9F}]")
    suspect = text.rlike(r"[\x{C2}\x{C3}\x{80}-\x{9F}]") & ~text.rlike(r"[^\x{00}-\x{FF}]")
    fixed = F.when(suspect, F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")))
    return F.when(fixed.isNotNull() & (F.regexp_count(fixed, odd) < F.regexp_count(text, odd)), fixed).otherwise(text)


def statement_text(text: Column) -> Column:
    """N4: repaired encoding, no-break spaces as spaces, one space between words; case is kept."""
    wide = F.translate(repaired(F.coalesce(text, F.lit(""))), "   ", "   ")
    return F.trim(F.regexp_replace(wide, r"\s+", " "))


def control_text(text: Column) -> Column:
    """N5: N4 in upper case without accents."""
    return F.upper(strip_accents(statement_text(text)))


def hash_text(text: Column) -> Column:
    """N6: N4 in upper case."""
    return F.upper(statement_text(text))


def economic_tokens(text: Column) -> Column:
    """N7: sorted distinct tokens without digits-only, short and noise tokens."""
    t = F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))
    keep = F.filter(F.split(t, " "), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$") & ~w.isin(NOISE_TOKENS))
    return F.array_sort(F.array_distinct(keep))


def context_shape(text: Column) -> Column:
    """N8: runs of digits as ``#``, anything but letters as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(text)), "[0-9]+", "#"), "[^a-z#]+", " "))


def audit_text(text: Column) -> Column:
    """N9: upper-case ASCII letters and digits, anything else as one space."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]+", " "))


def digits(text: Column) -> Column:
    """Digits alone; null when there is none."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def distinctive(tokens: Column) -> Column:
    """Tokens of three letters or more that are not generic."""
    return F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC_TOKENS))


def spread(rows: DataFrame, *kept: str | Column, each: Column, name: str) -> DataFrame:
    """``kept`` with one row for each entry of ``each``, called ``name``; entries are never null. An inner explode would have
    Spark first filter on the size of the array, with all that it is computed from once more for every place that names it."""
    return rows.select(*kept, F.explode_outer(each).alias(name)).where(F.col(name).isNotNull())


def alias_groups(tokens: Column) -> Column:
    """Names of the alias groups that a list of tokens touches."""
    named = [F.when(F.arrays_overlap(tokens, _words(words.split())), F.lit(group)) for group, words in ALIAS_GROUPS.items()]
    return F.array_compact(F.array(*named))


def document_in_text(text: Column) -> Column:
    """A 14-digit number as written in company documents, else a bare run of 11 or 14 digits; null without one."""
    written = F.regexp_extract(text, r"\b[0-9]{2}[.\s]?[0-9]{3}[.\s]?[0-9]{3}[/]?[0-9]{4}[-\s]?[0-9]{2}\b", 0)
    bare = F.regexp_extract(text, r"\b(?:[0-9]{11}|[0-9]{14})\b", 0)
    return F.coalesce(digits(written), F.nullif(bare, F.lit("")))


def installment(text: Column) -> Column:
    """struct(current, total) of the first ``n/m`` in a text; null without one."""
    found = F.regexp_extract(text, r"(?i)(?:parcela\s*)?([0-9]{1,2})\s*/\s*([0-9]{1,2})", 0)
    part = lambda i: F.regexp_extract(text, r"(?i)(?:parcela\s*)?([0-9]{1,2})\s*/\s*([0-9]{1,2})", i).cast("int")
    return F.when(found != "", F.named_struct(F.lit("current"), part(1), F.lit("total"), part(2)))
