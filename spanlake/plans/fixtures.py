"""Cases that the given texts lack, dealt to the rows of a given table; Spark and SQL share them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = [
    (1, "Pay DE89370400440532013000 or GB82WEST12345698765432 or DE89370400440532013001 today."),
    (2, "SSN 123-45-6789, social 666-12-3456, id 900-11-2222, 219-09-9999 and 123-00-4567"),
    (3, "Mail anna.kovacs@example.org or call phone +49 30 12345678 born 12/03/1984"),
    (4, "See https://intranet.corp/wiki and (https://docs.python.org/3/). Also www.wikipedia.org, http://10.0.0.5:8080/x"),
    (5, "Card 4111 1111 1111 1111 or 4111-1111-1111-1112; amex visa 5500005555555559"),
    (6, "https://acme.sharepoint.com/sites/hr https://github.com/a/b?access_token=abc https://linkedin.com/in/someone https://x.com/explore"),
    (7, "née Müller, é123-45-6789 and 10.1.2.3 on 2024-01-31 and March 5, 2023"),
    (8, "nothing here"),
    (9, ""),
    (10, "https://user:pw@host.example.com/ https://example.com/u/550e8400-e29b-41d4-a716-446655440000 https://drive.google.com/file https://unknown-host.biz/page"),
]
URLS = [
    "https://docs.python.org/3/library/re.html", "http://jenkins:8080/job/1", "https://user:pw@git.example.com/x", "http://192.168.1.10/admin", "https://wiki.corp.internal/page",
    "https://acme.atlassian.net/browse/X-1", "https://www.atlassian.net/", "https://docs.google.com/document/d/1", "https://docs.google.com", "https://linkedin.com/in/jane", "https://linkedin.com/jobs",
    "https://x.com/jane", "https://x.com/explore", "https://github.com/a?token=abc", "https://github.com/a?token=", "https://github.com/a?page=2", "https://github.com/@jane", "https://github.com/0123456789abcdef0123456789abcdef",
    "https://unknown.biz/", "file:///home/jane/x.txt", "file:///usr/lib/x", "www.wikipedia.org/wiki/A#sid=4", "https://gov.uk/tax", "https://notgov.uk/tax", "https://localhost:3000/x", "https://python.org:8443/a@b", "",
]
PATHS = [r"C:\Users\Anna Kovacs\Documents", "/home/anna/x", "/home/shared/x", "/usr/local/bin", r"\\server\share", "/media/anna/usb", "/run/media/anna", "/mnt/c/Users/bela/x", "/mnt/c/Users/public/x", "~/notes/0123456789abcdef0123456789abcdef", "/Users/"]
NUMBERS = [
    ("4111 1111 1111 1111", "CREDIT_CARD"), ("4111111111111112", "CREDIT_CARD"), ("411111111111", "CREDIT_CARD"), ("5500-0055-5555-5559", "CREDIT_CARD"), ("0000000000000", "CREDIT_CARD"),
    ("DE89 3704 0044 0532 0130 00", "IBAN"), ("DE89370400440532013001", "IBAN"), ("GB82WEST12345698765432", "IBAN"), ("gb82WEST12345698765432", "IBAN"), ("DE8", "IBAN"), ("FR1420041010050500013M02606", "IBAN"),
    ("123-45-6789", "SSN"), ("000-45-6789", "SSN"), ("666-45-6789", "SSN"), ("900-45-6789", "SSN"), ("899-01-0001", "SSN"), ("123-00-6789", "SSN"), ("123-45-0000", "SSN"), ("123456789", "SSN"), ("anything", "EMAIL"),
]
LISTS = [("hello*world", "any"), ("Eauon", "any"), ("das", "PERSON"), ("the thor", "ORGANIZATION")]


def values(rows: list[tuple], names: str) -> str:
    """The rows as a DuckDB table expression."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS v({names})"


def each(documents: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """id (doc_id), own (the text) and one of the rows for each document, by its id."""
    columns = names.split(", ")
    kinds = [next((type(r[c]) for r in rows if r[c] is not None), str) for c in range(len(columns))]
    lit = lambda v, kind: F.lit(v).cast("string" if kind is str else "int")
    cases = F.array(*(F.struct(*(lit(v, k).alias(c) for v, k, c in zip(r, kinds, columns))) for r in rows))
    dealt = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("own"), cases[F.coalesce(F.pmod("doc_id", F.lit(len(rows))), F.lit(0)).cast("int")].alias("case__"))
    return dealt.select("id", "own", "case__.*")


def each_sql(rows: list[tuple], names: str) -> str:
    """each() for DuckDB."""
    n, columns = len(rows), ", ".join(f"v.{c}" for c in names.split(", "))
    return f"(SELECT doc_id AS id, coalesce(d.text, '') AS own, {columns} FROM documents d JOIN {values([(i, *r) for i, r in enumerate(rows)], 'nth, ' + names)} ON nth = coalesce((doc_id % {n} + {n}) % {n}, 0))"


def texts(documents: DataFrame) -> DataFrame:
    """A case and the document's own text after it."""
    return each(documents, [(i, t) for i, t in TEXTS], "case_id, text").withColumn("text", F.concat_ws("\n", "text", "own"))


def texts_sql() -> str:
    return f"(SELECT id, case_id, text || chr(10) || own AS text FROM {each_sql(TEXTS, 'case_id, text')})"


CODE = [
    (1, "Please look:\n```python\nimport pandas as pd\ndef load_invoice(customer_name, total=0):\n    invoice_total = total + 1\n    # customer_name is a person\n    return invoice_total\nprint(load_invoice('a'))\n```\nDoes load_invoice work?"),
    (2, "```js\nconst userName = fetch(url);\nfunction showUser(userName) { console.log(`hi ${userName}`); }\n```"),
    (3, 'Traceback (most recent call last):\n  File "/home/anna/app/main.py", line 3, in load_invoice\n    x = 1\n  File "/usr/lib/python3/site-packages/a.py", line 9, in run\nValueError: bad \'customer_id\''),
    (4, "java.lang.NullPointerException: x\n\tat com.acme.Billing.load(Billing.java:12)\n\tat java.util.List.get(List.java:3)\n"),
    (5, "src/a.ts(12,5): error TS2339: Property 'customerName' does not exist"),
    (6, "public class InvoiceService {\n    private int MAX_SIZE = 3;\n    public String loadInvoice(int invoiceId) {\n        return \"\" + invoiceId;\n    }\n}"),
    (7, "Just prose about a table and its columns, nothing else."),
    (8, "<pre>x = 1</pre> und größer <code>y</code>"),
    (9, "package main\nimport \"fmt\"\nfunc total(items []int) int {\n\tsum := 0\n\tfor _, price := range items {\n\t\tsum += price\n\t}\n\treturn sum\n}"),
    (10, ""),
    (11, "./main.go:12:5: undefined: customerName"),
    (12, "e: src/a.kt:3:5: unresolved reference 'loadInvoice'"),
    (13, "KeyboardInterrupt"),
    (14, "com.acme.BillingExit: customer 7"),
    (15, "java.lang.Throwable"),
    (16, "acme.LedgerPanic: closed"),
    (17, "acme.SegmentFault"),
    (18, "  --> src/ledger.rs:4:9"),
    (19, '  File "/home/anna/app/main.py", line 3, in load_invoice'),
    (20, "\t/home/anna/ledger.go:12 +0x1d"),
]


def code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODE, "id long, text string")
