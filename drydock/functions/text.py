"""Text expressions: run names and replayed statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, max_len: int = 40) -> Column:
    """'Apply 10% discount' becomes 'apply-10-discount'."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.trim(dashed, F.lit("-")), 1, max_len)


#: Names that the pattern of tokens keeps whole, and that pattern.
PLAIN = r"^\w+$"
TOKENS = r"\w+|\W+"


def replay_on(statement: Column, sandbox: Column, production: Column, schema: Column) -> Column:
    """A statement written for a sandbox, as it reads for its production table.

    The sandbox's name is found as a whole word, whatever its case, with its schema or without, and
    becomes the production table's name, with the schema where one stood. All names are taken
    literally. Names inside string literals are replaced as well. One constant pattern parts any statement into
    words and what is between them; only names that are no words need a pattern of their own.
    """
    plain = sandbox.rlike(PLAIN) & schema.rlike(PLAIN)
    return F.when(plain, _replay_words(statement, sandbox, production, schema)).otherwise(
        _replay_found(statement, sandbox, production, schema)
    )


def _replay_words(statement: Column, sandbox: Column, production: Column, schema: Column) -> Column:
    tokens = F.regexp_extract_all(statement, F.lit(TOKENS), F.lit(0))
    named, within = F.lower(sandbox), F.lower(schema)

    def renamed(words: Column) -> Column:
        def each(word: Column, i: Column) -> Column:
            qualifies = (F.get(words, i + 1) == ".") & (F.lower(F.get(words, i + 2)) == named)
            return F.when(F.lower(word) == named, production).when((F.lower(word) == within) & qualifies, schema).otherwise(word)

        return F.array_join(F.transform(words, each), "")

    # The tokens stand in an array, so that they are found once however often they are looked at.
    return F.transform(F.array(tokens), renamed)[0]


def _replay_found(statement: Column, sandbox: Column, production: Column, schema: Column) -> Column:
    """The same for names with other characters, by a pattern for each row."""
    def literally(name: Column) -> Column:
        return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    pattern = F.concat(
        F.lit(r"(?i)(?<!\w)("), literally(schema), F.lit(r"\.)?(?<!\w)"), literally(sandbox), F.lit(r"(?!\w)")
    )
    kept = F.split(statement, pattern, -1)
    names = F.transform(
        F.regexp_extract_all(statement, pattern, F.lit(1)),
        lambda prefix: F.when(prefix == "", production).otherwise(F.concat_ws(".", schema, production)),
    )
    pairs = F.zip_with(kept, names, lambda text, name: F.array(text, name))
    return F.array_join(F.flatten(pairs), "")
