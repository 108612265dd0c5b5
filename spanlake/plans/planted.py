"""Code, error output and links set into documents, with names from their own words.

The given texts hold none of them. What is planted is an expression over a row,
so it grows with the table, and SQL can say what must be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.spans import computed

#: {0} to {3}: the first four words of four letters or more, or stand-ins, each with a letter of its own.
STAND_INS = ("alpha", "bravo", "carol", "delta")
LETTERS = "wxyz"
PIECES = (
    "```python\nimport pandas as pd\nfrom os import environ\ndef load_{0}({1}_name, limit=3):\n    {2}_total = pd.read_csv({1}_name, sep=';')\n    # {1}_name is a person\n    for {3}_row in {2}_total.head(limit):\n        print(f\"{{{3}_row.{0}_key}}\")\n    return render_{3}({2}_total)\n```",
    "```js\nimport {{ useState }} from 'react';\nconst {0}Name = $('#x');\n{0}Name.addClass('y');\n$.ajax({{ url: {1}Url, success: ({2}Data) => show{3}({2}Data) }});\nfunction load{1}(id) {{ console.log(`hi ${{{0}Name}}`); return {3}Box.fetch(id); }}\n```",
    "```java\nimport java.util.List;\npublic class {0}Service extends {1}Base {{\n    private int {2}Count = 3;\n    public {3}Order load{0}(int {1}Id) throws IOException {{\n        List<String> {3}Parts = helper.split({1}Id);\n        return {3}Parts;\n    }}\n}}\n```",
    "```go\npackage main\nimport \"fmt\"\nfunc {0}Total({1}Items []int) int {{\n\t{2}Sum := 0\n\tfor _, {3}Price := range {1}Items {{\n\t\t{2}Sum += {3}Price\n\t}}\n\tfmt.Println({2}Sum)\n\treturn {2}Sum\n}}\n```",
    "Traceback (most recent call last):\n  File \"/home/{0}/app/main.py\", line 3, in load_{1}\n    x = 1\n  File \"/usr/lib/python3/site-packages/a.py\", line 9, in run\nValueError: bad '{2}_id'",
    "see <code>{0}_{1} = {2}({3})</code>\nsrc/{0}.ts(12,5): error TS2339: Property '{1}Name' does not exist",
)


def words(text: Column) -> Column:
    """The four words that names are made of."""
    found = F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{4,})"), 1), 1, 4)
    return F.array(*(F.concat(F.coalesce(F.get(found, F.lit(k)), F.lit(STAND_INS[k])), F.lit(LETTERS[k])) for k in range(4)))


def sql_words(text: str = "text") -> str:
    """words() for DuckDB."""
    return "[" + ", ".join(f"coalesce(f[{k + 1}], '{STAND_INS[k]}') || '{LETTERS[k]}'" for k in range(4)) + "]"


def piece(kind: int, w: Column) -> Column:
    """A piece of code with these words in it."""
    parts: list[Column] = []
    text = PIECES[kind]
    at = 0
    while at < len(text):
        end = min((k for k in (text.find("{", at), text.find("}", at)) if k >= 0), default=len(text))
        parts += [F.lit(text[at:end])] if end > at else []
        if end < len(text) and text[end : end + 2] in ("{{", "}}"):
            parts.append(F.lit(text[end]))
            at = end + 2
        elif end < len(text):
            parts.append(w[int(text[end + 1])])
            at = end + 3
        else:
            at = end
    return F.concat(*parts)


def kind_of(key: Column) -> Column:
    return F.coalesce(F.pmod(key, F.lit(len(PIECES))), F.lit(0))


def coded(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents with kind, words and code, which is set after each text, on lines of its own."""
    df = computed(documents.withColumn("kind", kind_of(F.col(key)).cast("int")), "words", words(F.col("text")))
    code = F.lit(None).cast("string")
    for k in range(len(PIECES)):
        code = F.when(F.col("kind") == k, piece(k, F.col("words"))).otherwise(code)
    df = computed(df, "code", code)
    return df.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), "code", F.lit("\n\n")))
