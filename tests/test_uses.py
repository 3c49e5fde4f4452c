"""A class for each use of a name: two own programs with expectations derived by hand from the rules."""

from codeprep.functions import text as T
from codeprep.operators import uses as U

SHAPES = """#include <iostream>
class Shape {
public:
    int side;
    Shape(int s) : side(s) {}
    int area() const { return side * side; }
    int twice();
};
int Shape::twice() { return 2 * area(); }
int main() {
    Shape box(4);
    Shape *p = &box;
    std::cout << box.area() << p->side << box.twice();
    return 'x';
}"""

SHAPES_TOKENS = """class class0 { public : int var0 ;
    class0 ( int var1 ) : var0 ( var1 ) { }
    int func0 ( ) const { return var0 * var0 ; }
    int func1 ( ) ; } ;
    int class0 :: func1 ( ) { return lit0 * func0 ( ) ; }
    int main ( ) {
    class0 var2 ( lit1 ) ;
    class0 * var3 = & var2 ;
    std :: cout << var2 . var4 ( ) << var3 -> var0 << var2 . var5 ( ) ;
    return lit2 ; }""".split()

EARLY = """int total;
int scale(int total) { int d = total * later(total); if (d > total) { return d; } return top; }
int later(int d) { return d; }
struct Box { int scale; };
int last() { struct Box b; b.scale = scale(3); return b.scale; }
"""

EARLY_TOKENS = """int var0 ;
    int func0 ( int var0 ) { int var1 = var0 * func1 ( var0 ) ; if ( var1 > var0 ) { return var1 ; } return var2 ; }
    int func1 ( int var1 ) { return var1 ; }
    struct struct0 { int var3 ; } ;
    int func2 ( ) { struct struct0 var4 ; var4 . var3 = var3 ( lit0 ) ; return var4 . var3 ; }""".split()


def lexed(spark, program):
    df = spark.createDataFrame([(1, program), (2, None), (3, ""), (None, program)], "doc_id long, code string")
    rows = U.obfuscate_uses(df.select("doc_id", T.lex_input_raw("code").alias("code"))).collect()
    assert len(rows) == 1
    return rows[0]


def test_a_method_used_as_a_member_has_both_classes(spark):
    r = lexed(spark, SHAPES)
    assert r["transformed_tokens"] == SHAPES_TOKENS
    assert r["func_dict"] == {"area": "func0", "twice": "func1"} and r["class_dict"] == {"Shape": "class0"}
    assert r["var_dict"] == {"side": "var0", "s": "var1", "box": "var2", "p": "var3", "area": "var4", "twice": "var5"}
    assert r["lit_dict"] == {"2": "lit0", "4": "lit1", "'x'": "lit2"}


def test_uses_before_declarations_and_fields_named_like_functions(spark):
    r = lexed(spark, EARLY)
    assert r["transformed_tokens"] == EARLY_TOKENS
    assert r["func_dict"] == {"scale": "func0", "later": "func1", "last": "func2"}
    assert r["var_dict"] == {"total": "var0", "d": "var1", "top": "var2", "scale": "var3", "b": "var4"}


def test_unbalanced_brackets_and_lone_tokens(spark):
    df = spark.createDataFrame([(1, "} } int f(int a) {"), (2, "x"), (3, "class"), (4, "{ { a( }")], "doc_id long, code string")
    got = {r["doc_id"]: r["transformed_tokens"] for r in U.obfuscate_uses(df).collect()}
    assert got == {1: "} } int func0 ( int var0 ) {".split(), 2: ["var0"], 3: ["class"], 4: "{ { func0 ( }".split()}


def test_one_exchange_and_one_tokenizer(spark):
    df = spark.createDataFrame([(1, SHAPES)], "doc_id long, code string")
    plan = U.obfuscate_uses(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_whole_table_against_its_statement(spark):
    import __spark_entry__ as E
    from conftest import SF001
    from oracle import compare, duck
    name = "name_uses"
    info = compare(spark, duck(SF001), name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert info["match"] and info["spark_rows"] > 0, info
