"""Notes with planted faults, for checks that find nothing in the tables: built alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that show credentials, or look as if they did; none is a real one.
SECRETS = (
    "DB_PASSWORD=hunter2",
    "export CLIENT_SECRET: abc def",
    'voir AWS_SECRET_ACCESS_KEY=valeur et password="deux mots" fin',
    "Authorization: Basic dXNlcjpwYXNz",
    "ici authorization : bearer abc.def puis la suite",
    "clef hf_" + "a1" * 12,
    "jeton gho_" + "b2" * 12 + " ghp_" + "c3" * 12,
    "AIza" + "D" * 35,
    "sk-" + "e5" * 10 + " xoxb-" + "f6" * 8,
    "AKIA" + "G7" * 8,
    "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----",
    "le jeton reste dans son coffre, rien à masquer",
)
#: Links that no note can answer.
FALSE = ' [["x"]] [[a, b]]'


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PATHS = (
    (50, 3, "concat('commun-', cast({q} % 5 as string), '.md')"),
    (50, 7, "concat('Nom-Été-', cast({q} % 20 as string), '.md')"),
    (50, 8, "concat('nom_ete-', cast({q} % 20 as string), 's.md')"),
    (40, 5, "concat('cle', cast({q} % 3 as string), '.pem')"),
    (40, 6, "concat('mon_Token', cast({q} % 3 as string), '.md')"),
    (60, 9, "'note (1).md'"),
    (60, 11, "'note (conflit de Marie).md'"),
)


def path_case(spark: bool) -> str:
    """The path of a planted note, in the SQL of either engine."""
    when = []
    for every, rest, name in _PATHS:
        quotient = f"cast(floor(doc_id / {every}) as bigint)" if spark else f"(doc_id // {every})"
        name = name.replace("{q}", quotient)
        when.append(f"WHEN doc_id % {every} = {rest} THEN {name if spark else name.replace('as string', 'as varchar')}")
    return f"CASE {' '.join(when)} ELSE relative_path END"


_LINKED = "CASE WHEN doc_id % 9 = 1 THEN {false} WHEN doc_id % 9 = 2 THEN concat(' [[commun-', cast(doc_id % 5 as {text}), ']]') ELSE '' END"
_SECRET = "CASE doc_id % {n} {whens} ELSE '' END".format(n=len(SECRETS) + 1, whens=" ".join(f"WHEN {i} THEN {_quoted(chr(10) + x)}" for i, x in enumerate(SECRETS)))


def documents(real: DataFrame) -> DataFrame:
    """(doc_id, directory, relative_path, text) with faults planted by doc_id."""
    whens = F.lit("")
    for i, line in reversed(list(enumerate(SECRETS))):
        whens = F.when(F.col("doc_id") % (len(SECRETS) + 1) == i, F.lit("\n" + line)).otherwise(whens)
    linked = F.when(F.col("doc_id") % 9 == 1, F.lit(FALSE)).when(F.col("doc_id") % 9 == 2, F.concat(F.lit(" [[commun-"), (F.col("doc_id") % 5).cast("string"), F.lit("]]"))).otherwise(F.lit(""))
    return real.select("doc_id", "directory", F.expr(path_case(True)).alias("relative_path"), F.concat(F.coalesce("text", F.lit("")), linked, whens).alias("text"))


SQL = f"""planted AS (SELECT doc_id, directory, {path_case(False)} AS relative_path,
  coalesce(text, '') || {_LINKED.format(false=_quoted(FALSE), text="varchar")} || {_SECRET} AS text FROM documents)"""


def over(sql: str) -> str:
    """A query's SQL over the planted notes."""
    head, rest = sql.split("WITH ", 1)
    return f"{head}WITH {SQL}, {rest.replace('FROM documents', 'FROM planted')}"
