"""Fill-in-the-middle rewriting of documents, by escaped markers and SQL functions alone.

A text is a run of units: white space with the word after it, or the white space at its end. A delimiter that the
escaped text cannot hold is put after every unit; counting it counts units, and what lies between two of them is
cut out by rank. All randomness comes from a hash of the seed and the document's id, so a document is rewritten
alike in every run, on every executor and after every lost task.

Defined results: a null text counts as empty, and an empty one stays plain. A null id is hashed as if it were
written as nothing. Rows of one id are drawn alike, each with its own text. Texts that hold a marker stay plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: White space and the word after it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The delimiter, and the sign that escapes both. Neither is white space, so escaping moves no unit's border.
DELIMITER, ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """The text without the delimiter: both signs become a pair of the escape and a letter."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _plain_text(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(DELIMITER), F.lit("")))


def _between(text: Column, left: str, right: str | None) -> Column:
    """What stands after the marker left, up to the marker right or the end; each marker occurs once."""
    return F.substring_index(F.substring_index(text, right, 1) if right else text, left, -1)


def draws(seed: int, key: Column, n: int = 4) -> list[Column]:
    """The first n groups of eight hexadecimal digits of the hash of seed and key, as whole numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of."""
    psm = F.concat(_between(output, PREFIX, SUFFIX), _between(output, MIDDLE, None), _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), _between(output, MIDDLE, None), _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, keys: list[str], key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The columns keys, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null where plain) and output.

    rate of 100 documents are rewritten, spm of 100 of these with the suffix first. Two draws choose how many units
    stand before the cuts. One projection over the scan: no shuffle, and memory for one text a row.
    """
    h1, h2, h3, h4 = draws(seed, F.col(key))
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = F.regexp_replace(escaped(whole), UNIT, "$0" + DELIMITER)
    rows = docs.select(*[F.col(k) for k in keys], whole.alias("__whole"), marked.alias("__marked"), *[h.alias(f"__h{k}") for k, h in enumerate((h1, h2, h3, h4), 1)])
    # every unit has one delimiter, and what is not a unit has none
    rows = rows.withColumn("n", (F.octet_length("__marked") - F.octet_length(F.replace("__marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    held = F.contains("__whole", F.lit(PREFIX)) | F.contains("__whole", F.lit(SUFFIX)) | F.contains("__whole", F.lit(MIDDLE))
    rows = rows.withColumns({
        "form": F.when((F.col("n") == 0) | held | (F.col("__h3") % 100 >= rate), "plain").when(F.col("__h4") % 100 < spm, "spm").otherwise("psm"),
        "__a": F.least(F.expr("__h1 % (n + 1)"), F.expr("__h2 % (n + 1)")).cast("int"),
        "__b": F.greatest(F.expr("__h1 % (n + 1)"), F.expr("__h2 % (n + 1)")).cast("int"),
    })
    rows = rows.withColumn("__upto", F.expr(f"substring_index(__marked, '{DELIMITER}', __b)"))
    parts = {
        "__prefix": F.expr(f"substring_index(__marked, '{DELIMITER}', __a)"),
        "__middle": F.expr(f"substring_index(__upto, '{DELIMITER}', __a - __b)"),
        # the text ends with a delimiter, so the last n - b units follow the delimiter n - b + 1 places from the end
        "__suffix": F.expr(f"substring_index(__marked, '{DELIMITER}', __b - cast(n as int) - 1)"),
    }
    rows = rows.withColumns({name: F.when(F.col("form") != "plain", _plain_text(part)) for name, part in parts.items()})
    psm = F.concat(F.lit(PREFIX), "__prefix", F.lit(SUFFIX), "__suffix", F.lit(MIDDLE), "__middle")
    spm_first = F.concat(F.lit(SUFFIX), "__suffix", F.lit(PREFIX), "__prefix", F.lit(MIDDLE), "__middle")
    return rows.select(
        *keys, "n", "form", F.length("__prefix").cast("long").alias("prefix_chars"), F.length("__middle").cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_first).otherwise(F.col("__whole")).alias("output"),
    )
