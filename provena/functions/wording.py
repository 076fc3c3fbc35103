"""What bank lines, documents and questions say, by wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.checks import ACCOUNT, CARD, EMAIL, IBAN, PHONE, iban_ok, luhn_ok, mod97
from provena.functions.normalise import MONTHS, _map, phrase_in, skeleton
from provena.functions.text import fold
from provena.functions.web import registrable_domain

#: Free mailbox providers, whose domains name nobody (fixed values).
FREE_MAIL = ["gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "sapo.pt", "live.com"]
#: Wording of bank lines by rule, folded (fixed values).
WORDS = {
    "card_repayment": ["pagamento cartao credito", "card repayment", "credit card payment", "liquidacao cartao"],
    "cash_withdrawal": ["levantamento atm", "levantamento", "cash withdrawal", "atm"],
    "cash_deposit": ["deposito numerario", "cash deposit"],
    "payout": ["stripe payments", "stripe payout", "paypal transfer", "sumup", "tpa", "zettle"],
    "tax": ["pagamento ao estado", "autoridade tributaria", "imposto", "tax office"],
    "grant": ["subsidio", "iefp apoio", "grant"],
    "bank_fee": ["comissao", "manutencao conta", "account fee", "imposto selo s comissao"],
    "loan": ["prest emprestimo", "loan instalment", "amortizacao"],
    "payroll": ["ordenado", "salario", "vencimento", "salary", "payroll"],
}
#: What evidence each rule asks for (fixed values).
EXPECTED = {
    "zero_amount": "nothing_moved",
    "bank_marked_internal": "internal",
    "card_repayment": "card_statement",
    "cash_withdrawal": "cash",
    "cash_deposit": "cash",
    "payout": "payout_report",
    "tax": "tax_document",
    "grant": "grant_letter",
    "bank_fee": "bank_evidence",
    "loan": "loan_contract",
    "payroll": "payroll",
    "money_in": "customer_invoice",
    "card_purchase": "receipt",
    "money_out": "supplier_invoice",
}
#: Categories that follow from the rule, and phrases that tell the others (fixed values).
RULE_CATEGORY = {"cash_withdrawal": "cash", "cash_deposit": "cash", "bank_marked_internal": "transfer", "card_repayment": "card_repayment", "payout": "payout", "tax": "taxes", "bank_fee": "bank_fees", "loan": "loans", "payroll": "salaries"}
PHRASE_CATEGORY = {"electricidade": "energy", "energia": "energy", "restaurante": "meals", "cafe": "meals", "combustivel": "fuel", "seguro": "insurance", "renda": "rent", "software": "software", "telecomunicacoes": "telecom"}
PERSONAL = ["restaurante", "cinema", "supermercado", "farmacia", "ginasio", "brinquedos"]
SENSITIVE = ["ordenado", "salario", "vencimento", "baixa medica", "penhora", "tribunal"]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_phrase(x: Column | str, symbol: str = "€") -> Column:
    """An amount with its symbol, thousands and two decimals; a minus stands before the symbol."""
    x = _col(x).cast("decimal(18,2)")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(x), 2))


def count_phrase(n: Column | str, noun: str) -> Column:
    """A count and its noun, plural but for one."""
    n = _col(n)
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, noun).otherwise(f"{noun}s"))


def domain_verdict(sender: Column | str, own_domain: Column | str) -> Column:
    """``known`` (the supplier's own domain), ``lookalike`` (another that reads like it), ``free_mail`` or ``unknown``."""
    d = registrable_domain(F.lower(F.regexp_extract(_col(sender), "@([^@>\\s]+)", 1)))
    own = F.lower(_col(own_domain))
    return F.when(d == own, "known").when(d.isin(*FREE_MAIL), "free_mail").when(skeleton(d) == skeleton(own), "lookalike").otherwise("unknown")


#: The mark that parts an opening bracket of the text itself from those of tokens.
_APART = "\u200b"


def _pii_kind(value: Column) -> Column:
    """The kind of a found value; null where its check digits say that it is none."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), F.when(iban_ok(value), "iban"))
        .when(value.startswith("+"), F.when(F.length(digits).between(9, 15), "phone"))
        .when(F.length(digits) == 21, F.when(mod97(digits) == 1, "bank_account"))
        .otherwise(F.when(luhn_ok(digits), "card"))
    )


def redact(text: Column | str) -> Column:
    """struct(text, tokens, kinds): personal data replaced by [[k]], what each token stood for, and of which kind.

    Mail addresses, international phone numbers, and IBANs, 21-digit accounts and card numbers whose check digits are
    right; equal values have one token. Texts are cut where the values were found, so nothing else is touched but
    opening brackets: each is followed by a zero-width mark, by which :func:`restore` tells them from tokens.
    """
    t = F.coalesce(_col(text), F.lit(""))
    pattern = f"{EMAIL}|{IBAN}|{PHONE}|{ACCOUNT}|{CARD}"
    plain = lambda c: F.replace(c, F.lit("["), F.lit("[" + _APART))

    def made(found: Column) -> Column:
        known = F.array_distinct(F.transform(F.filter(found, lambda f: f["kind"].isNotNull()), lambda f: f["value"]))
        return F.transform(F.array(known), lambda tokens: put(found, tokens))[0]

    def put(found: Column, tokens: Column) -> Column:
        told = F.transform(found, lambda f: F.when(f["kind"].isNull(), plain(f["value"])).otherwise(F.concat(F.lit("[["), (F.array_position(tokens, f["value"]) - 1).cast("string"), F.lit("]]"))))
        parts = F.zip_with(F.split(t, pattern, -1), told, lambda a, b: F.concat(plain(a), F.coalesce(b, F.lit(""))))
        return F.struct(F.array_join(parts, "").alias("text"), tokens.alias("tokens"), F.transform(tokens, _pii_kind).alias("kinds"))

    values = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda v: F.struct(v.alias("value"), _pii_kind(v).alias("kind")))
    return F.transform(F.array(values), made)[0]


def restore(text: Column | str, tokens: Column | str) -> Column:
    """The text before :func:`redact`."""
    t, tokens = _col(text), _col(tokens)
    mark = r"\[" + _APART + r"|\[\[[0-9]+\]\]"
    meant = F.transform(F.regexp_extract_all(t, F.lit(mark), 0), lambda m: F.when(m == "[" + _APART, "[").otherwise(F.get(tokens, F.regexp_extract(m, "[0-9]+", 0).try_cast("int"))))
    return F.array_join(F.zip_with(F.split(t, mark, -1), meant, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def expected_evidence(lines: DataFrame) -> DataFrame:
    """``rule`` and ``expected`` for bank lines (id, amount, kind, text): the first rule that applies decides.

    Nothing moved, marked as internal, card repayment, cash, payout, tax, grant, fee, loan, payroll; then by direction.
    """
    said = {rule: phrase_in("text", words).isNotNull() for rule, words in WORDS.items()}
    out, money_in = F.col("amount") < 0, F.col("amount") > 0
    fee = phrase_in("text", ["comissao", "account fee", "manutencao conta"]).isNotNull()
    rule = (
        F.when(F.col("amount") == 0, "zero_amount")
        .when(F.col("kind") == "internal", "bank_marked_internal")
        .when(out & said["card_repayment"], "card_repayment")
        .when(out & said["cash_withdrawal"], "cash_withdrawal")
        .when(money_in & said["cash_deposit"], "cash_deposit")
        .when(money_in & said["payout"], "payout")
        .when(out & said["tax"] & ~fee, "tax")
        .when(money_in & said["grant"], "grant")
        .when(out & said["loan"], "loan")
        .when(out & ((F.col("kind") == "fee") | said["bank_fee"]), "bank_fee")
        .when(out & said["payroll"], "payroll")
        .when(money_in, "money_in")
        .when(F.col("kind") == "card", "card_purchase")
        .otherwise("money_out")
    )
    told = _map([(k, F.lit(v)) for k, v in EXPECTED.items()])
    return lines.withColumn("rule", rule).withColumn("expected", F.element_at(told, F.col("rule")))


def spending_category(lines: DataFrame) -> DataFrame:
    """``category`` by rule, then by wording, else other; whether the wording is personal or sensitive."""
    by_rule = F.try_element_at(_map([(k, F.lit(v)) for k, v in RULE_CATEGORY.items()]), F.col("rule"))
    phrase = phrase_in("text", list(PHRASE_CATEGORY))
    by_phrase = F.try_element_at(_map([(k, F.lit(v)) for k, v in PHRASE_CATEGORY.items()]), phrase)
    return lines.withColumns({"category": F.coalesce(by_rule, by_phrase, F.lit("other")), "maybe_personal": phrase_in("text", PERSONAL).isNotNull(), "sensitive": phrase_in("text", SENSITIVE).isNotNull()})


def sample_lines(events: DataFrame) -> DataFrame:
    """Bank lines (id, amount, kind, text) made from events, one wording for each remainder of the id by 14."""
    k = (F.col("event_id") % 14).cast("int")
    texts = ["ajuste", "transferência entre contas", "PAGAMENTO CARTÃO CRÉDITO 1234", "LEVANTAMENTO ATM LISBOA", "STRIPE PAYMENTS UK", "PAGAMENTO AO ESTADO 123", "IEFP Apoio", "ENCARGOS", "PREST EMPRÉSTIMO capital", "IMPOSTO SELO S/ COMISSÃO", "Ordenado Ana Costa", "Cliente Lda", "Electricidade do Norte", "Restaurante O Pátio"]
    kinds = ["other", "internal", "direct_debit", "card", "transfer_in", "transfer_out", "transfer_in", "fee", "direct_debit", "other", "transfer_out", "transfer_in", "direct_debit", "card"]
    size = F.greatest(F.abs(F.col("value").cast("decimal(18,2)")), F.lit("0.01").cast("decimal(18,2)"))
    amount = F.when(k == 0, F.lit("0.00").cast("decimal(18,2)")).when(k.isin(4, 6, 11), size).otherwise(-size)
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k + 1)
    return events.select(F.col("event_id").alias("id"), amount.cast("decimal(18,2)").alias("amount"), at(kinds).alias("kind"), at(texts).alias("text"))


def contract_terms(text: Column | str) -> Column:
    """struct(kind, percent, amount) of a stated retention, deposit or deduction of an advance."""
    t = fold(text)
    percent = F.replace(F.regexp_extract(t, r"(\d{1,3}(?:[.,]\d+)?)\s*%", 1), F.lit(","), F.lit(".")).try_cast("decimal(6,2)")
    amount = F.regexp_extract(t, r"(?:less|menos|deducao de|deduct) .*?(\d+(?:\.\d{1,2})?)\b", 1).try_cast("decimal(18,2)")
    kind = F.when(t.rlike(r"retencao|retention|garantia") & percent.isNotNull(), "retention").when(t.rlike(r"deposit|sinal|adiantamento") & percent.isNotNull(), "deposit")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), percent).alias("percent"), F.when(kind.isNull() & t.rlike("advance|adiantamento"), amount).alias("amount"))


#: Units of packages, their basis and how much of it one is (fixed values).
UNITS = {"kg": ("kg", "1"), "g": ("kg", "0.001"), "mg": ("kg", "0.000001"), "l": ("l", "1"), "lt": ("l", "1"), "dl": ("l", "0.1"), "cl": ("l", "0.01"), "ml": ("l", "0.001")}


def unit_basis(text: Column | str) -> Column:
    """struct(basis, per_unit): kilograms or litres in one package (count x size), else one unit."""
    t = F.replace(fold(text), F.lit(","), F.lit("."))
    get = lambda i: F.regexp_extract(t, r"\b(?:(\d+)\s?x\s?)?(\d+(?:\.\d+)?)\s?(kg|g|mg|lt|l|dl|cl|ml)\b", i)
    basis = F.try_element_at(_map([(k, F.lit(b)) for k, (b, _) in UNITS.items()]), get(3))
    factor = F.try_element_at(_map([(k, F.lit(f).cast("decimal(10,6)")) for k, (_, f) in UNITS.items()]), get(3))
    count = F.coalesce(get(1).try_cast("decimal(6,0)"), F.lit(1).cast("decimal(6,0)"))
    size = (count * get(2).try_cast("decimal(10,3)") * factor).cast("decimal(18,6)")
    return F.struct(F.coalesce(basis, F.lit("unit")).alias("basis"), F.coalesce(size, F.lit(1).cast("decimal(18,6)")).alias("per_unit"))


def product_key(text: Column | str) -> Column:
    """The words of a description without its package sizes."""
    t = F.regexp_replace(fold(text), r"\b(?:\d+\s?x\s?)?\d+(?:[.,]\d+)?\s?(?:kg|g|mg|lt|l|dl|cl|ml|un|pack)?\b", " ")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(t, "[^a-z]+"), lambda w: F.length(w) > 1))), " ")


def period_of(question: Column | str, today: Column) -> Column:
    """struct(start, end) of the period that a question names; nulls without one.

    Today, this and last month and year, the last N days, a quarter, a month (the latest that has begun) and a year.
    """
    t = fold(question)
    month_start, year_start = F.trunc(today, "month"), F.trunc(today, "year")
    span = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    days = F.regexp_extract(t, r"last (\d+) days", 1).try_cast("int")
    quarter = F.regexp_extract(t, r"\bq([1-4])\b", 1).try_cast("int")
    of_quarter = F.add_months(year_start, (quarter - 1) * 3)
    names = "|".join(sorted({n for all_ in MONTHS.values() for n in all_ if len(n) > 3 or n == "may"}, key=len, reverse=True))
    number = F.try_element_at(_map([(n, F.lit(k)) for k, all_ in MONTHS.items() for n in all_]), F.regexp_extract(t, rf"\b({names})\b", 1))
    of_month = F.add_months(year_start, number - 1)
    of_month = F.when(of_month > today, F.add_months(of_month, -12)).otherwise(of_month)
    year = F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    return (
        F.when(t.rlike(r"\btoday\b"), span(today, today))
        .when(t.contains("this month"), span(month_start, F.last_day(today)))
        .when(t.contains("last month"), span(F.add_months(month_start, -1), F.date_sub(month_start, 1)))
        .when(t.contains("this year"), span(year_start, F.date_sub(F.add_months(year_start, 12), 1)))
        .when(t.contains("last year"), span(F.add_months(year_start, -12), F.date_sub(year_start, 1)))
        .when(days.isNotNull(), span(F.date_sub(today, days), today))
        .when(quarter.isNotNull(), span(of_quarter, F.date_sub(F.add_months(of_quarter, 3), 1)))
        .when(number.isNotNull(), span(of_month, F.last_day(of_month)))
        .when(year.isNotNull(), span(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))))
        .otherwise(span(F.lit(None), F.lit(None)))
    )


#: Words that tell what is asked for, in order of precedence (fixed values).
INTENTS = {"missing": ["missing", "in falta", "without receipt"], "income": ["earn", "income", "sales", "received"], "spending": ["spend", "spent", "cost", "paid"], "documents": ["invoice", "invoices", "document", "documents", "receipts"]}


def intent_of(question: Column | str) -> Column:
    """The intent of a question; null where no word tells it."""
    return F.coalesce(*[F.when(phrase_in(question, words).isNotNull(), intent) for intent, words in INTENTS.items()])
