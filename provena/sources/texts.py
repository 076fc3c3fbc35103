"""Readers of mail, archives, pages and labelled texts.

Each is a small parser inside a task, fed and collected by Spark; what can be an expression is one.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.money import amount_readings
from provena.functions.text import fold

MAIL = "message_id string, in_reply_to string, references array<string>, sender string, subject string, sent_at timestamp, text string, html string, parts array<struct<name:string,type:string,bytes:bigint,sha256:string>>, depth int, problem string"


def _mail(raw: bytes, most_parts: int, depth: int = 0) -> list[dict]:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    row = {"depth": depth, "problem": None, "parts": [], "text": None, "html": None}
    ids = lambda h: re.findall(r"<[^<>\s]+>", str(message.get(h, "")))
    row |= {"message_id": (ids("Message-ID") or [None])[0], "in_reply_to": (ids("In-Reply-To") or [None])[0], "references": ids("References"), "sender": str(message.get("From", "")) or None, "subject": str(message.get("Subject", "")) or None}
    try:
        row["sent_at"] = message["Date"].datetime if message["Date"] else None
    except (AttributeError, ValueError):
        row["sent_at"] = None
    out = [row]
    for n, part in enumerate(message.walk()):
        if n >= most_parts:
            row["problem"] = "too many parts"
            break
        if part.is_multipart():
            if part.get_content_type() == "message/rfc822" and part is not message and depth < 3:
                for inner in part.get_payload():
                    out += _mail(inner.as_bytes(), most_parts, depth + 1)
            continue
        data = part.get_payload(decode=True) or b""
        kind = part.get_content_type()
        if part.get_filename() or kind not in ("text/plain", "text/html"):
            row["parts"].append({"name": part.get_filename(), "type": kind, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        elif row["text" if kind == "text/plain" else "html"] is None:
            row["text" if kind == "text/plain" else "html"] = data.decode(part.get_content_charset() or "utf-8", "replace")
    return out


def read_mail(files: DataFrame, *, path: str = "path", content: str = "content", most_parts: int = 200) -> DataFrame:
    """Messages of ``binaryFile`` rows: one row for each, nested ones with a depth; broken ones with a problem."""
    names = [c.split()[0] for c in MAIL.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for at, raw in zip(batch[path], batch[content], strict=True):
                try:
                    found = _mail(bytes(raw), most_parts)
                except Exception as e:  # a message that the parser cannot read is a result
                    found = [{"problem": type(e).__name__}]
                made += [{path: at, **dict.fromkeys(names), **m} for m in found]
            frame = pd.DataFrame(made, columns=[path, *names])
            frame["sent_at"] = pd.to_datetime(frame["sent_at"], utc=True)
            frame["depth"] = frame["depth"].fillna(0).astype("int32")
            yield frame

    return files.select(path, content).mapInPandas(rows, f"{path} string, {MAIL}")


def expand_zips(files: DataFrame, *, path: str = "path", content: str = "content", most_entries: int = 1000, most_bytes: int = 50_000_000, most_ratio: int = 200, most_depth: int = 2) -> DataFrame:
    """Members of ZIP files, nested ones included, within budgets of entries, bytes and ratio.

    One row for each member, with its bytes or the reason it was skipped; a file that is no archive is one row.
    """

    def members(raw: bytes, prefix: str, depth: int, budget: list[int]) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            yield prefix, None, "not an archive"
            return
        for n, info in enumerate(archive.infolist()):
            name = f"{prefix}{info.filename}"
            if n >= most_entries:
                yield prefix, None, "too many entries"
                return
            if info.is_dir():
                continue
            if info.flag_bits & 1:
                yield name, None, "encrypted"
            elif info.file_size > budget[0]:
                yield name, None, "too large"
            elif info.compress_size and info.file_size / info.compress_size > most_ratio:
                yield name, None, "ratio"
            else:
                try:
                    data = archive.read(info)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError) as e:
                    yield name, None, f"damaged: {type(e).__name__}"
                    continue
                budget[0] -= len(data)
                if data[:4] == b"PK\x03\x04" and depth < most_depth:
                    yield from members(data, f"{name}!", depth + 1, budget)
                else:
                    yield name, data, None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, raw in zip(batch[path], batch[content], strict=True):
                found = list(members(bytes(raw), "", 0, [most_bytes]))
                yield pd.DataFrame([(at, *m) for m in found], columns=[path, "member", "content", "skipped"])

    return files.select(path, content).mapInPandas(rows, f"{path} string, member string, content binary, skipped string")


class _Page(HTMLParser):
    """Visible text and anchors of a page."""

    HIDDEN, BREAKS = {"script", "style", "template", "noscript", "head"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "article", "section", "footer", "nav", "table", "ul"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.anchors, self.hidden, self.href, self.label = [], [], 0, None, []
        self.forms = self.passwords = 0
        self.title, self.in_title = [], False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.in_title = tag == "title"
        self.hidden += tag in self.HIDDEN and tag != "head"
        if tag in self.BREAKS:
            self.text.append("\n")
        if tag == "a" and attrs.get("href"):
            self.href, self.label = attrs["href"], []
        self.forms += tag == "form"
        self.passwords += tag == "input" and (attrs.get("type") or "").lower() == "password"

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if tag in self.HIDDEN and tag != "head":
            self.hidden = max(0, self.hidden - 1)
        if tag == "a" and self.href is not None:
            self.anchors.append((self.href, " ".join("".join(self.label).split())))
            self.href = None
        if tag in self.BREAKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)
            if self.href is not None:
                self.label.append(data)


PAGE = "text string, title string, anchors array<struct<href:string,label:string>>, forms int, passwords int"


def read_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each page's visible text, title, anchors and form signals; a null page is an empty one."""
    schema = ", ".join([*[f"`{n}` {t}" for n, t in pages.dtypes], PAGE])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for source in batch[html]:
                p = _Page()
                p.feed(source or "")
                p.close()
                lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
                made.append(("\n".join(x for x in lines if x), " ".join("".join(p.title).split()), [{"href": h, "label": x} for h, x in p.anchors], p.forms, p.passwords))
            extra = pd.DataFrame(made, columns=["text", "title", "anchors", "forms", "passwords"], index=batch.index)
            yield pd.concat([batch, extra.astype({"forms": "int32", "passwords": "int32"})], axis=1)

    return pages.mapInPandas(rows, schema)


def json_ld(html: Column) -> Column:
    """The JSON-LD bodies of a page, as texts."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))


def structured_invoices(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Schema.org invoices and orders in JSON-LD: number, total, currency, seller, day."""
    v = F.try_parse_json("body")
    get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    found = pages.select(*keys, F.explode(json_ld(F.col(html))).alias("body"))
    out = found.select(*keys, get("$['@type']").alias("kind"), get("$.confirmationNumber", "$.orderNumber", "$.identifier").alias("number"), get("$.totalPaymentDue.price", "$.totalPaymentDue.value", "$.price", "$.acceptedOffer.price").try_cast("decimal(18,2)").alias("total"), get("$.totalPaymentDue.priceCurrency", "$.totalPaymentDue.currency", "$.priceCurrency").alias("currency"), get("$.provider.name", "$.seller.name", "$.broker.name").alias("seller"), F.try_to_date(F.left(get("$.paymentDueDate", "$.orderDate"), F.lit(10)), "yyyy-MM-dd").alias("day"))
    return out.where(F.col("kind").isin("Invoice", "Order"))


def listed_invoices(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Links of a supplier's list page that name an invoice number, with the row's text."""
    rows = read_pages(pages.select(*keys, html), html).select(*keys, F.inline("anchors"))
    number = F.regexp_extract("label", r"([A-Z]{1,4}[ /-]?[0-9]{2,4}[/-][0-9]{1,8}|[0-9]{6,})", 1)
    return rows.withColumn("number", F.when(number != "", number)).where("number IS NOT NULL")


#: Points of a link that may lead to an invoice (fixed values).
LINK_POINTS = {"word": 40, "action": 15, "context": 20, "path": 20, "pdf": 30, "button": 10, "domain": 10, "negative": -60, "social": -100}


def link_scores(anchors: DataFrame, href: str = "href", label: str = "label", context: str | None = None) -> DataFrame:
    """How likely a link leads to an invoice, by its words, path and host."""
    name, url = fold(label), F.lower(href)
    points = lambda k, c: F.when(F.coalesce(c, F.lit(False)), LINK_POINTS[k]).otherwise(0)
    score = (
        points("word", name.rlike("invoice|factura|fatura|rechnung|facture|recibo|receipt"))
        + points("action", name.rlike("download|view|descarregar|descargar|ver|telecharger|herunterladen"))
        + points("path", url.rlike("invoice|fatura|factura|billing|receipt"))
        + points("pdf", url.rlike(r"\.pdf($|[?#])"))
        + points("negative", name.rlike("unsubscribe|privacy|terms|preferences|help") | url.rlike("unsubscribe|privacy"))
        + points("social", url.rlike(r"(facebook|twitter|instagram|linkedin|youtube)\.com"))
    )
    if context:
        score = score + points("context", fold(context).rlike("invoice|fatura|factura"))
    return anchors.withColumn("points", score.cast("bigint"))


def labelled_fields(rows: DataFrame, keys: list[str], text: str, labels: dict[str, list[str]]) -> DataFrame:
    """A26: "Label: value" lines: the first value of each field in the order of the text."""
    lines = rows.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("line", "raw"))
    name, value = fold(F.regexp_extract("raw", r"^\s*([^:]{2,40}):", 1)), F.trim(F.regexp_extract("raw", r"^[^:]{2,40}:\s*(.+)$", 1))
    field = F.coalesce(*[F.when(name.isin(ws), F.lit(f)) for f, ws in labels.items()])
    hits = lines.select(*keys, "line", field.alias("field"), value.alias("value")).where("field IS NOT NULL AND value != ''")
    return hits.groupBy(*keys, "field").agg(F.min_by("value", "line").alias("value"), F.count("*").alias("n"))


def text_lines(rows: DataFrame, keys: list[str], text: str, tolerance: str = "0.01") -> DataFrame:
    """Rows "description quantity price total" of an invoice text, kept only if quantity * price = total."""
    lines = rows.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("line", "raw"))
    shape = r"^\s*(.+?)\s+([0-9]+(?:[.,][0-9]{1,3})?)\s+([0-9.,]+)\s+([0-9.,]+)\s*$"
    # each reading is made once: as a generator's output it is not put again into every expression that uses it
    once = lambda **columns: F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    parts = lines.where(F.col("raw").rlike(r"[0-9.,]\s*$")).select(*keys, "line", once(**{f"p{i}": F.regexp_extract("raw", shape, i) for i in (1, 2, 3, 4)})).where("p4 != ''")
    number = lambda c: F.get(amount_readings(c), F.lit(0))
    made = {"description": F.trim("p1"), "quantity": F.replace("p2", F.lit(","), F.lit(".")).try_cast("decimal(18,3)"), "unit_price": number("p3"), "total": number("p4")}
    out = parts.select(*keys, F.col("line").cast("bigint").alias("line"), once(**made))
    return out.where(F.abs(F.col("quantity") * F.col("unit_price") - F.col("total")) <= F.lit(tolerance).cast("decimal(5,2)"))


def statement_lines(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A19: "date kind number debit credit balance" lines of a supplier's account statement."""
    shape = r"^\s*([0-9]{2}/[0-9]{2}/[0-9]{4})\s+(\S+)\s+(\S+)\s+([0-9.,]+|-)\s+([0-9.,]+|-)\s+(-?[0-9.,]+)\s*$"
    lines = rows.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("row", "raw")).where(F.col("raw").rlike(shape))
    part = lambda i: F.regexp_extract("raw", shape, i)
    number = lambda i: F.coalesce(F.get(amount_readings(part(i)), F.lit(0)), F.lit(0)).cast("decimal(18,2)")
    out = lines.select(*keys, F.col("row").cast("bigint").alias("row"), F.try_to_date(part(1), "dd/MM/yyyy").alias("on"), F.lower(part(2)).alias("kind"), part(3).alias("number"), number(4).alias("debit"), number(5).alias("credit"), number(6).alias("balance"))
    return out


def till_days(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Z reports: one row for each day with cash, card and total; ``adds_up`` says whether they agree."""
    found = labelled_fields(rows, keys, text, {"day": ["data", "date", "fecha"], "cash": ["dinheiro", "cash", "numerario", "efectivo"], "card": ["multibanco", "cartao", "card", "tarjeta"], "total": ["total"]})
    wide = found.groupBy(*keys).pivot("field", ["day", "cash", "card", "total"]).agg(F.first("value"))
    number = lambda c: F.get(amount_readings(c), F.lit(0)).cast("decimal(18,2)")
    out = wide.select(*keys, F.coalesce(F.try_to_date("day", "yyyy-MM-dd"), F.try_to_date("day", "dd/MM/yyyy")).alias("day"), number("cash").alias("cash"), number("card").alias("card"), number("total").alias("total"))
    return out.withColumn("adds_up", F.coalesce("cash", F.lit(0)) + F.coalesce("card", F.lit(0)) == F.col("total"))


def payslips(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Name, month and net pay of payslips; rows that lack any of them are left out."""
    found = labelled_fields(rows, keys, text, {"person": ["nome", "name", "nombre"], "month": ["periodo", "mes", "month"], "net": ["liquido", "net pay", "liquido a receber", "neto"], "gross": ["iliquido", "gross", "bruto"]})
    wide = found.groupBy(*keys).pivot("field", ["person", "month", "net", "gross"]).agg(F.first("value"))
    number = lambda c: F.get(amount_readings(c), F.lit(0)).cast("decimal(18,2)")
    month = F.regexp_replace("month", r"^([0-9]{2})/([0-9]{4})$", "$2-$1")
    return wide.select(*keys, "person", month.alias("month"), number("net").alias("net"), number("gross").alias("gross")).where("person IS NOT NULL AND month IS NOT NULL AND net IS NOT NULL")


def lease_plan(leases: DataFrame, keys: list[str], start: str = "start", months: str = "months", amount: str = "rent") -> DataFrame:
    """A lease's instalments: one row for each month of its term."""
    days = F.posexplode(F.sequence(F.lit(0), F.col(months).cast("int") - 1)).alias("n", "k")
    return leases.select(*keys, start, amount, days).select(*keys, (F.col("n") + 1).cast("bigint").alias("instalment"), F.add_months(start, F.col("k")).alias("due_on"), F.col(amount).cast("decimal(18,2)").alias("amount"))


def obligations(rows: DataFrame, keys: list[str], text: str, issuers: dict[str, list[str]]) -> DataFrame:
    """Letters that ask for something: issuer, whether they confirm it, day due and amount."""
    folded = fold(text)
    issuer = F.coalesce(*[F.when(folded.rlike("|".join(ws)), F.lit(k)) for k, ws in issuers.items()])
    due = F.regexp_extract(folded, r"(?:until|due|ate|antes de|hasta)\s+(?:o dia\s+|el\s+)?([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})", 1)
    amount = F.regexp_extract(folded, r"([0-9][0-9.,]*)\s*(?:eur|€)", 1)
    day = F.try_to_date(F.replace(due, F.lit("-"), F.lit("/")), "d/M/yyyy")
    confirmed = folded.rlike("payment received|pagamento recebido|confirmamos|pago recibido|we confirm")
    out = rows.select(*keys, issuer.alias("issuer"), confirmed.alias("confirmed"), day.alias("due_on"), F.get(amount_readings(amount), F.lit(0)).cast("decimal(18,2)").alias("amount"))
    return out.where("issuer IS NOT NULL AND (due_on IS NOT NULL OR amount IS NOT NULL OR confirmed)")
