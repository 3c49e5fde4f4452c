"""Inputs derived from the driver tables (they hold no C or C++ code).

Each fixture exists twice: as a Spark DataFrame and as the equivalent DuckDB
SQL, so oracle statements start from the same rows.  Everything is derived
from whole tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def _s(c) -> F.Column:
    return c.cast("string")


def code_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, code)``: includes, both comment kinds, a struct, a
    function, a string with blanks, a tab."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    k = F.col("p_partkey")
    code = F.concat(
        F.lit('#include <stdio.h>\n#include "part'), _s(k % 3), F.lit('.h"\n// '), F.col("p_brand"),
        F.when(k % 4 == 0, F.lit("\n#define SWAP(a,b) \\\n do { int t=a; \\\n a=b; } while(0)")).otherwise(F.lit("")),
        F.lit("\nstruct Part"), _s(k % 7), F.lit(" { int size; char *name; };\nint f"), _s(k % 5),
        F.lit("(struct Part"), _s(k % 7), F.lit(" p, int x) { /* "), F.col("p_type"),
        F.lit(" */\n\tint y = "), _s(F.col("p_size")), F.lit('; printf("%d '), F.col("p_name"),
        F.lit('", y); return x * (y + p.size); }\n'))
    return p.select(k.alias("doc_id"), F.lit("c").alias("lang"), code.alias("code"))


SQL_CODE_C = """
SELECT p_partkey AS doc_id, 'c' AS lang,
  '#include <stdio.h>' || chr(10) ||
  '#include "part' || CAST(p_partkey % 3 AS VARCHAR) || '.h"' || chr(10) ||
  '// ' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN chr(10) || '#define SWAP(a,b) ' || chr(92) || chr(10) ||
  ' do { int t=a; ' || chr(92) || chr(10) || ' a=b; } while(0)' ELSE '' END || chr(10) ||
  'struct Part' || CAST(p_partkey % 7 AS VARCHAR) || ' { int size; char *name; };' || chr(10) ||
  'int f' || CAST(p_partkey % 5 AS VARCHAR) || '(struct Part' || CAST(p_partkey % 7 AS VARCHAR) ||
  ' p, int x) { /* ' || p_type || ' */' || chr(10) || chr(9) ||
  'int y = ' || CAST(p_size AS VARCHAR) || '; printf("%d ' || p_name ||
  '", y); return x * (y + p.size); }' || chr(10) AS code
FROM part
"""


def code_cpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, code)``: include without blank, a class with a method,
    ``std::cout``, a trailing line comment."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    k = F.col("p_partkey")
    code = F.concat(
        F.lit("#include <iostream>\n#include<vector>\nclass Item"), _s(k % 4),
        F.lit(" { public: int size; int area(int k) { return k * size; } };\nint main() { Item"), _s(k % 4),
        F.lit(" it; std::cout << it.area("), _s(F.col("p_size")), F.lit(') << "'), F.col("p_type"),
        F.lit('"; return 0; } // '), F.col("p_brand"), F.lit("\n"))
    return p.select(k.alias("doc_id"), F.lit("cpp").alias("lang"), code.alias("code"))


SQL_CODE_CPP = """
SELECT p_partkey AS doc_id, 'cpp' AS lang,
  '#include <iostream>' || chr(10) || '#include<vector>' || chr(10) ||
  'class Item' || CAST(p_partkey % 4 AS VARCHAR) ||
  ' { public: int size; int area(int k) { return k * size; } };' || chr(10) ||
  'int main() { Item' || CAST(p_partkey % 4 AS VARCHAR) || ' it; std::cout << it.area(' ||
  CAST(p_size AS VARCHAR) || ') << "' || p_type || '"; return 0; } // ' || p_brand || chr(10) AS code
FROM part
"""


#: Programs of varied scopes: uses before declarations, names of a function and
#: a variable, methods used as members, members defined outside their class,
#: locals named like functions, pointers and products, character literals.
SCOPE_PROGRAMS = [
    "int main() { return area@K(@N) + top; }\nint area@K(int k) { return k * @N; }\nint top = 'a';\n",
    "int size(int n) { return n; }\nstruct Box@K { int size; char *label; };\n"
    "int main() { struct Box@K b; b.size = size(@N); b.label = \"@T\"; return b.size; }\n",
    "class Shape@K {\npublic:\n int side; Shape@K(int s) : side(s), name('@K') {}\n int area() const { return side * side; }\n"
    "private: char name; };\nint main() { Shape@K *p = new Shape@K(@N); std::cout << p->area() << \"@T\"; delete p; return 0; }\n",
    "namespace geo@K { class Line { public: int length(); int from; int to; }; }\n"
    "int geo@K::Line::length() { return to - from; }\nint main() { geo@K::Line l; l.from = @N; return l.length(); }\n",
    "int total(int *p, int n) { int s = 0; for (int i = 0; i < n; i++) { s = s + p[i]; } return s; }\n"
    "int main() { int total = @N; Box x(total); if (x > total) { x.total = total@K(); } return total; }\n",
    "char *name; double rate@K;\nint f(int a, char c) { int d = a * c; if (c == '\\0') return d; char *q = name;\n"
    " return a > d ? f(a, '@K') : rate@K; }\nint g() { return f(@N, name[0]); } /* @T */\n",
]


def code_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, code)``: one of ``SCOPE_PROGRAMS`` a part, with its type, size and key."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    k = F.col("p_partkey")
    code = F.coalesce(*[F.when(k % len(SCOPE_PROGRAMS) == i, F.lit(text)) for i, text in enumerate(SCOPE_PROGRAMS)])
    for mark, value in (("@K", _s(k % 4)), ("@N", _s(F.col("p_size"))), ("@T", F.col("p_type"))):
        code = F.replace(code, F.lit(mark), value)
    return p.select(k.alias("doc_id"), code.alias("code"))


def _sql_scopes() -> str:
    cases = " ".join(f"WHEN {i} THEN '{text.replace(chr(39), chr(39) * 2)}'" for i, text in enumerate(SCOPE_PROGRAMS))
    return f"""
SELECT p_partkey AS doc_id, replace(replace(replace(CASE p_partkey % {len(SCOPE_PROGRAMS)} {cases} END,
  '@K', CAST(p_partkey % 4 AS VARCHAR)), '@N', CAST(p_size AS VARCHAR)), '@T', p_type) AS code FROM part
"""


SQL_CODE_SCOPES = _sql_scopes()


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, kind, c_key, cpp_key)``: hashes of real texts, input order =
    doc_id.  The C side is a document's text; the C++ side is the text of the
    document's conversation (first turn) where there is one, else the
    document's first line, so both sides repeat as the texts do."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    v = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).filter("turn = 0") \
        .groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("text").alias("other"))
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "pair").when(i % 3 == 1, "c").otherwise("cpp")
    other = F.coalesce("other", F.element_at(F.split("text", "\n"), 1))
    return d.join(v, "doc_id", "left").select(
        i.alias("doc_id"), kind.alias("kind"),
        F.when(i % 3 != 2, F.sha2(F.col("text").cast("binary"), 256)).alias("c_key"),
        F.when(i % 3 != 1, F.sha2(other.cast("binary"), 256)).alias("cpp_key"))


SQL_PAIR_KEYS = """
SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 THEN 'pair' WHEN doc_id % 3 = 1 THEN 'c' ELSE 'cpp' END AS kind,
  CASE WHEN doc_id % 3 <> 2 THEN sha256(text) END AS c_key,
  CASE WHEN doc_id % 3 <> 1 THEN sha256(coalesce(other, split_part(text, chr(10), 1))) END AS cpp_key
FROM documents LEFT JOIN (SELECT conv_id, min(text) AS other FROM conversations WHERE turn = 0 GROUP BY conv_id) v
  ON v.conv_id = documents.doc_id
"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, parent_id)``: root -> regions -> nations -> suppliers."""
    r = read_table(spark, sf_dir, "region", ["r_regionkey"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    root = spark.range(1).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    return (root
            .unionByName(r.select(F.concat(F.lit("r"), _s(F.col("r_regionkey"))).alias("node_id"),
                                  F.lit("root").alias("parent_id")))
            .unionByName(n.select(F.concat(F.lit("n"), _s(F.col("n_nationkey"))).alias("node_id"),
                                  F.concat(F.lit("r"), _s(F.col("n_regionkey"))).alias("parent_id")))
            .unionByName(s.select(F.concat(F.lit("s"), _s(F.col("s_suppkey"))).alias("node_id"),
                                  F.concat(F.lit("n"), _s(F.col("s_nationkey"))).alias("parent_id"))))


SQL_TREE_NODES = """
SELECT 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id
UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'root' FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
"""
