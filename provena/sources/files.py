"""Readers of delimited, JSON, XML and binary files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.money import amount_readings
from provena.functions.text import squash

MONEY = "decimal(18,2)"


def sniff_delimiter(header: str, candidates: str = ";,\t|") -> str:
    """The candidate that occurs most in a header line; the first of them on a tie."""
    return max(candidates, key=lambda c: (header.count(c), -candidates.index(c)))


def read_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], *, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file whose columns are bound by their usual names.

    ``aliases`` maps each wanted column to the headers that mean it, compared without case, accents and separators;
    a column that the file lacks comes back null. Everything is text: casts belong to the caller. Only the first
    line is read to find the delimiter.
    """
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    sep = sep or sniff_delimiter(head[0][0] if head else ";")
    rows = spark.read.csv(path, sep=sep, header=True, encoding=encoding, multiLine=True, escape='"', enforceSchema=False)
    plain = lambda s: "".join(c for c in s.lower().translate(str.maketrans("àáâãçéêíóôõúñü", "aaaaceeiooounu")) if c.isalnum())
    found = {plain(c): c for c in reversed(rows.columns)}
    bound = []
    for name, known in aliases.items():
        at = next((found[plain(k)] for k in [name, *known] if plain(k) in found), None)
        bound.append((F.col(f"`{at}`") if at else F.lit(None).cast("string")).alias(name))
    return rows.select(bound)


BANK_LINE = (
    "transactionId string, internalTransactionId string, bookingDate string, valueDate string, transactionAmount struct<amount:string,currency:string>, creditorName string, debtorName string, "
    "creditorAccount struct<iban:string>, debtorAccount struct<iban:string>, remittanceInformationUnstructured string, remittanceInformationUnstructuredArray array<string>"
)


def bank_lines(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Provider rows (JSON text) as booked bank lines; the counterparty is the other side of the sign."""
    r = raw.select("*", F.from_json(payload, BANK_LINE).alias("r"))
    amount = F.col("r.transactionAmount.amount").cast(MONEY)
    out = amount < 0
    text = F.coalesce("r.remittanceInformationUnstructured", F.array_join("r.remittanceInformationUnstructuredArray", " "), F.lit(""))
    rest = [c for c in raw.columns if c != payload]
    return r.select(
        *rest,
        F.coalesce("r.transactionId", "r.internalTransactionId").alias("provider_id"),
        F.coalesce(F.to_date("r.bookingDate"), F.to_date("r.valueDate")).alias("booked_on"),
        amount.alias("amount"),
        F.upper("r.transactionAmount.currency").alias("currency"),
        F.coalesce(F.when(out, F.col("r.creditorName")).otherwise(F.col("r.debtorName")), F.lit("")).alias("counterparty"),
        F.when(out, F.col("r.creditorAccount.iban")).otherwise(F.col("r.debtorAccount.iban")).alias("counterparty_iban"),
        F.trim(text).alias("description"),
    )


def stable_ids(rows: DataFrame, tenant: Column, account: Column, order: Sequence[Column], fingerprint: Sequence[str] = ("booked_on", "amount", "currency", "counterparty", "description")) -> DataFrame:
    """Ids that a second download repeats: of the provider's id, or of the line's content and its number that day."""
    print_of = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fingerprint]), 256)
    key = F.coalesce(F.col("provider_id"), F.concat(F.lit("#"), print_of))
    keyed = rows.withColumns({"__tenant": tenant, "__account": account, "__key": key})
    nth = F.row_number().over(W.partitionBy("__tenant", "__account", "booked_on", "__key").orderBy(*order))
    full = F.concat_ws("|", "__tenant", "__account", "__key", F.when(F.col("provider_id").isNull(), nth.cast("string")).otherwise(F.lit("0")))
    return keyed.withColumn("id", F.left(F.sha2(full, 256), F.lit(16))).drop("__tenant", "__account", "__key")


#: Leading bytes of known types in hex (fixed values).
MAGIC = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("504B0304", "application/zip"), ("504B0506", "application/zip"), ("1F8B", "application/gzip"))


def sniffed_type(content: Column, declared: Column | None = None, name: Column | None = None) -> Column:
    """A10: the type by leading bytes, then by the start of the text, then as declared, then by the file's name."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC:
        out = F.coalesce(out, F.when(head.startswith(magic), F.lit(kind)))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "UTF-8")))
    out = F.coalesce(out, F.when(text.startswith("<?xml"), "application/xml"), F.when(text.startswith("<!doctype html") | text.startswith("<html"), "text/html"), F.when(text.rlike(r"^[\[{]"), "application/json"))
    if declared is not None:
        out = F.coalesce(out, F.lower(F.trim(F.element_at(F.split(declared, ";"), 1))))
    if name is not None:
        ends = {"pdf": "application/pdf", "csv": "text/csv", "txt": "text/plain", "eml": "message/rfc822", "xml": "application/xml", "json": "application/json", "html": "text/html", "zip": "application/zip"}
        suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
        out = F.coalesce(out, *[F.when(suffix == e, F.lit(k)) for e, k in ends.items()])
    return F.coalesce(out, F.lit("application/octet-stream"))


def intact(content: Column, claimed: Column) -> Column:
    """Whether an upload has the hash that its sender claimed."""
    return F.sha2(content, 256) == F.lower(claimed)


def safe_xml(x: Column) -> Column:
    """XML text of any size without a document type, else null: entities are never expanded. See :func:`xml_problem`."""
    return F.when(~_declares(x), F.regexp_replace(x, r"<(/?)[A-Za-z0-9]+:", "<$1"))


def _declares(x: Column) -> Column:
    """Whether a text has a document type or an entity; the pattern runs only over texts with a declaration at all."""
    return F.contains(x, F.lit("<!")) & x.rlike(r"(?i)<!doctype|<!entity")


def xml_problem(x: Column) -> Column:
    """Why :func:`safe_xml` gives nothing: ``empty`` or ``document_type``; null where it gives the text."""
    return F.when(x.isNull() | (F.trim(x) == ""), "empty").when(_declares(x), "document_type")


#: How XML is read: text as it stands; a text that doesn't parse is kept under ``_corrupt_record``.
XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}


def _xml_fields(paths: Sequence[str]) -> str:
    """Fields that hold the elements at ``paths`` below an element, each of which may be repeated."""
    below = [p.split("/", 1) for p in paths]
    inner = {n: [rest for m, *more in below if m == n for rest in more] for n in dict.fromkeys(p[0] for p in below)}
    return ", ".join(f"`{n}`: array<{f'struct<{_xml_fields(rest)}>' if rest else 'string'}>" for n, rest in inner.items())


def _parsed(x: Column, paths: Sequence[str]) -> Column:
    """XML text parsed once into the elements at ``paths``: an XPath function parses the whole text for each of them."""
    return F.from_xml(x, f"struct<{_xml_fields(paths)}, _corrupt_record: string>", XML_OPTIONS)


def _path(v: Column, *paths: str) -> Column:
    """The first path whose first element, in the order of the text, is not empty."""

    def first(path: str) -> Column:
        head, *rest = path.split("/")
        found = v[head]
        for name in rest:
            found = F.flatten(F.filter(found[name], lambda e: e.isNotNull()))
        return F.get(found, F.lit(0))

    return F.coalesce(*[F.when(first(p) != "", first(p)) for p in paths])


_CII = "SupplyChainTradeTransaction"
EINVOICE_PATHS = {
    "invoice_number": ("ID", "ExchangedDocument/ID"),
    "issue_date": ("IssueDate", "ExchangedDocument/IssueDateTime/DateTimeString"),
    "due_date": ("DueDate", f"{_CII}/ApplicableHeaderTradeSettlement/SpecifiedTradePaymentTerms/DueDateDateTime/DateTimeString"),
    "currency": ("DocumentCurrencyCode", f"{_CII}/ApplicableHeaderTradeSettlement/InvoiceCurrencyCode"),
    "supplier_name": ("AccountingSupplierParty/Party/PartyLegalEntity/RegistrationName", "AccountingSupplierParty/Party/PartyName/Name", f"{_CII}/ApplicableHeaderTradeAgreement/SellerTradeParty/Name"),
    "supplier_tax_id": ("AccountingSupplierParty/Party/PartyTaxScheme/CompanyID", f"{_CII}/ApplicableHeaderTradeAgreement/SellerTradeParty/SpecifiedTaxRegistration/ID"),
    "net_amount": ("LegalMonetaryTotal/TaxExclusiveAmount", f"{_CII}/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation/TaxBasisTotalAmount"),
    "vat_amount": ("TaxTotal/TaxAmount", f"{_CII}/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation/TaxTotalAmount"),
    "gross_amount": ("LegalMonetaryTotal/TaxInclusiveAmount", f"{_CII}/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation/GrandTotalAmount"),
    "iban": ("PaymentMeans/PayeeFinancialAccount/ID", f"{_CII}/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementPaymentMeans/PayeePartyCreditorFinancialAccount/IBANID"),
}
CII_TYPE = "ExchangedDocument/TypeCode"


def einvoice_fields(rows: DataFrame, xml: str) -> DataFrame:
    """The critical fields of UBL 2.1 and UN/CEFACT CII invoices; null where absent, with ``problem`` for a refused text. Prefixes are ignored."""
    day = lambda c: F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyyMMdd"))
    found = {name: _path(F.col("__v"), *paths) for name, paths in EINVOICE_PATHS.items()}
    shaped = {"issue_date": day, "due_date": day, **{n: lambda c: c.try_cast(MONEY) for n in ("net_amount", "vat_amount", "gross_amount")}, "iban": lambda c: F.regexp_replace(c, r"\s", "")}
    whole = F.col("__v._corrupt_record").isNull()
    tag = lambda name: F.contains("__x", F.lit(name)) & F.col("__x").rlike(rf"<([A-Za-z0-9]+:)?{name}\b")
    kind = F.when(tag("CreditNote"), "credit_note").when(tag("Invoice"), "invoice").when(_path(F.col("__v"), CII_TYPE) == "381", "credit_note").when(tag("CrossIndustryInvoice"), "invoice")
    parsed = rows.withColumn("__x", F.when(~_declares(F.col(xml)), F.col(xml))).withColumn("__v", _parsed(F.col("__x"), [CII_TYPE, *(p for paths in EINVOICE_PATHS.values() for p in paths)]))
    out = {n: F.when(whole, shaped[n](c) if n in shaped else c) for n, c in found.items()}
    return parsed.withColumns({"problem": F.coalesce(xml_problem(F.col(xml)), F.when(~whole, "malformed")), "doc_type": F.when(whole, kind), **out}).drop("__x", "__v")


LINE_PATHS = {
    "line_id": ("ID",),
    "description": ("Item/Name",),
    "quantity": ("InvoicedQuantity", "CreditedQuantity"),
    "unit_price": ("Price/PriceAmount",),
    "net": ("LineExtensionAmount",),
    "rate": ("Item/ClassifiedTaxCategory/Percent",),
}


def einvoice_lines(rows: DataFrame, xml: str, keys: Sequence[str]) -> DataFrame:
    """The lines of UBL invoices and credit notes: number, description, quantity, unit price, net, rate.

    A text is parsed once for all its lines. Where they don't lie right below the root, or the text is broken, each
    line's element is cut out and parsed alone.
    """
    below = [p for paths in LINE_PATHS.values() for p in paths]
    parsed = rows.withColumn("__x", F.when(~_declares(F.col(xml)), F.col(xml))).withColumn("__v", _parsed(F.col("__x"), [f"{kind}/{p}" for kind in ("InvoiceLine", "CreditNoteLine") for p in below]))
    whole = F.coalesce(F.col("__v.InvoiceLine"), F.col("__v.CreditNoteLine"))
    plain = F.col("__v._corrupt_record").isNull() & (F.col("__v.InvoiceLine").isNull() != F.col("__v.CreditNoteLine").isNull())
    cut = F.when(F.contains("__x", F.lit("InvoiceLine")) | F.contains("__x", F.lit("CreditNoteLine")), F.regexp_extract_all(safe_xml(F.col("__x")), F.lit(r"(?s)(<(?:InvoiceLine|CreditNoteLine)\b.*?</(?:InvoiceLine|CreditNoteLine)>)"), 1))
    read = F.when(plain, F.transform(whole, lambda v: F.struct(v.alias("v"), F.lit(None).cast("string").alias("x")))).otherwise(F.transform(cut, lambda x: F.struct(F.lit(None).cast(f"struct<{_xml_fields(below)}>").alias("v"), x.alias("x"))))
    lines = parsed.select(*keys, F.posexplode(read).alias("__n", "__l"))
    alone = F.from_xml("__l.x", f"struct<{_xml_fields(below)}>", XML_OPTIONS)
    lines = lines.withColumn("__v", F.when(F.col("__l.x").isNull(), F.col("__l.v")).otherwise(alone))
    some = lambda n: _path(F.col("__v"), *LINE_PATHS[n])
    return lines.select(*keys, (F.col("__n") + 1).cast("bigint").alias("line"), some("line_id").alias("line_id"), some("description").alias("description"), some("quantity").try_cast("decimal(18,3)").alias("quantity"), some("unit_price").try_cast("decimal(18,6)").alias("unit_price"), some("net").try_cast(MONEY).alias("net"), some("rate").try_cast("decimal(6,3)").alias("rate"))


def json_fields(rows: DataFrame, payload: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Typed fields by JSON path ({name: (path, type)}); null where absent or of another type."""
    v = F.try_parse_json(payload)
    return rows.withColumns({n: F.try_variant_get(v, p, t) for n, (p, t) in paths.items()})


def qr_fields(payload: Column) -> Column:
    """Key:value*key:value payloads as a map; null for anything else."""
    return F.when(payload.rlike(r"^[A-Z][A-Z0-9]?:[^*]*(\*[A-Z][A-Z0-9]?:[^*]*)+$"), F.str_to_map(payload, F.lit(r"\*"), F.lit(":")))


def epc_fields(payload: Column) -> Column:
    """A credit-transfer QR (BCD lines) as a struct; null for anything else."""
    lines = F.split(payload, r"\r?\n")
    at = lambda i: F.when(F.get(lines, F.lit(i)) != "", F.trim(F.get(lines, F.lit(i))))
    amount = F.when(at(7).startswith("EUR"), F.substring(at(7), 4, 20).try_cast(MONEY))
    return F.when(payload.rlike(r"^BCD\r?\n00[12]\r?\n"), F.struct(at(4).alias("bic"), at(5).alias("name"), at(6).alias("iban"), amount.alias("amount"), at(9).alias("reference"), at(10).alias("text")))


#: Headers of payout reports by layout (ours): what each wanted column is called.
SETTLEMENT_ALIASES = {
    "kind": ["type", "transaction type", "category"],
    "reference": ["id", "source", "order", "transaction id"],
    "on": ["date", "created", "created (UTC)", "settlement date"],
    "sales": ["gross", "amount", "gross amount"],
    "fees": ["fee", "fee amount", "commission"],
    "refunds": ["refund", "refund amount"],
    "stated_net": ["net", "net amount", "payout"],
    "payout_id": ["transfer", "payout id", "batch"],
}


def settlement_lines(raw: DataFrame) -> DataFrame:
    """Payout report rows (bound by SETTLEMENT_ALIASES) with amounts; a fee is a cost whatever its sign."""
    money = lambda c: F.coalesce(F.get(amount_readings(c), F.lit(0)), F.lit(0).cast(MONEY)).cast(MONEY)
    day = F.coalesce(F.try_to_date("on", "yyyy-MM-dd"), F.try_to_date("on", "dd/MM/yyyy"), F.try_to_date(F.substring("on", 1, 10), "yyyy-MM-dd"))
    out = raw.withColumns({"on": day, "sales": money("sales"), "fees": F.abs(money("fees")), "refunds": F.abs(money("refunds"))})
    computed = (F.col("sales") - F.col("fees") - F.col("refunds")).cast(MONEY)
    return out.withColumns({"stated_net": F.get(amount_readings("stated_net"), F.lit(0)).cast(MONEY), "net": computed}).withColumn("adds_up", F.col("stated_net").isNull() | (F.col("stated_net") == F.col("net")))


def settlement_reports(lines: DataFrame) -> DataFrame:
    """One header for each payout: totals of its lines, and whether all of them add up."""
    total = lambda c: F.sum(c).cast("decimal(28,2)").alias(c)
    return lines.groupBy("payout_id").agg(F.max("on").alias("payout_date"), F.count("*").alias("n_lines"), total("sales"), total("fees"), total("refunds"), total("net"), F.bool_and("adds_up").alias("adds_up"))


def event_log(spark: SparkSession, path: str, tenant: str | None = None, after: int = 0) -> DataFrame:
    """A tenant's events after a sequence number, from all batches; each holds tenants in order, so column statistics prune the scan."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).where(F.col("seq") > after)
    return (rows if tenant is None else rows.where(F.col("tenant_id") == tenant)).orderBy("tenant_id", "seq")


def header_key(x: Column) -> Column:
    """How a header is compared: without case, accents and separators."""
    return squash(x)
