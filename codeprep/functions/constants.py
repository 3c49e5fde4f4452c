"""Fixed values.

The lists marked "fixed values" must stay exactly as written: results are
defined by them (which words stay readable, which headers are injected, ...).
"""

# --- fixed values: C / C++ keywords that are never obfuscated (99 words) ---
KEYWORDS = [
    "alignas", "alignof", "and", "and_eq", "asm",
    "atomic_cancel", "atomic_commit", "atomic_noexcept", "auto", "bitand",
    "bitor", "bool", "break", "case", "catch",
    "char", "char8_t", "char16_t", "char32_t", "class",
    "co_await", "co_return", "co_yield", "compl", "concept",
    "const", "consteval", "constexpr", "constinit", "const_cast",
    "continue", "decltype", "default", "delete", "do",
    "double", "dynamic_cast", "else", "enum", "explicit",
    "export", "extern", "false", "float", "for",
    "friend", "goto", "if", "inline", "int", "long",
    "mutable", "namespace", "new", "noexcept", "not",
    "not_eq", "nullptr", "operator", "or", "or_eq",
    "private", "protected", "public", "register", "reinterpret_cast",
    "return", "short", "signed", "sizeof", "static",
    "static_assert", "static_cast", "struct", "switch", "synchronized",
    "template", "this", "thread_local", "throw", "true",
    "try", "typedef", "typeid", "typename", "union",
    "unsigned", "using", "virtual", "void", "volatile",
    "wchar_t", "while", "xor", "xor_eq",
    "_Bool", "_Complex", "_Imaginary", "restrict",
]

# --- fixed values: names kept as written, checked before the class/struct rule ---
SPECIAL_NAMES = ["std", "main", "cout", "cin", "override", "vector"]

# --- fixed values: type words kept as written, checked after the class/struct rule ---
TYPE_WORDS = ["string", "int", "char", "float", "double"]

# --- fixed values: prefixes of obfuscated names (vocabulary filter) ---
ALIAS_PREFIXES = ["func", "var", "lit", "class", "struct"]

# --- fixed values: special tokens of the id vocabulary, ids 0..3 in this order ---
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[SOS]", "[EOS]"]
PAD_ID, UNK_ID, SOS_ID, EOS_ID = 0, 1, 2, 3
UNK_TOKEN = "[UNK]"

# --- fixed values: preprocessor words merged with a preceding '#' ---
DIRECTIVE_WORDS = ["include", "define", "pragma", "error", "warning", "if",
                   "ifdef", "ifndef", "elif", "else", "endif"]

# --- fixed values: header block injected in front of hosted C++ solutions ---
# (the line for <sstream> carries a trailing blank, as in the source list)
COMMON_HEADERS = "\n".join([
    "#include <iostream>",
    "#include <vector>",
    "#include <string>",
    "#include <algorithm>",
    "#include <cmath>",
    "#include <map>",
    "#include <set>",
    "#include <numeric>",
    "#include <queue>",
    "#include <stack>",
    "#include <deque>",
    "#include <utility>",
    "#include <functional>",
    "#include <tuple>",
    "#include <sstream> ",
    "#include <iomanip>",
])
ALL_IN_ONE_HEADER = "#include <bits/stdc++.h>"

# --- fixed values: reference defaults of the stage parameters ---
MAX_TOKENS = 1000            # analysis: drop rows with more tokens
MIN_DOC_FREQ = 100           # clean: vocabulary keeps tokens seen in >= this many rows
MAX_UNK_RATIO = 0.02         # clean: drop rows whose [UNK] share is above this
MAX_DIST_OFFSET = 1000       # distance lookup offset
VAL_RATIO = 0.05
TEST_RATIO = 0.05
MAX_SEQ_LEN = 1000
KEYWORD_HITS = 1000          # search: newest hits kept per keyword
ROW_CAP = 50000              # rows kept per language
SAMPLE_SIZE = 120000         # folder sampling size
FILE_CAP = 100000            # cap on collected files

# Our own allow-list (not taken from anywhere): C standard library functions
# that stay readable, like ``printf`` in the documented examples.
STD_FUNCTIONS = [
    "printf", "scanf", "fprintf", "fscanf", "sprintf", "snprintf", "sscanf",
    "puts", "gets", "fgets", "fputs", "putchar", "getchar", "fopen", "fclose",
    "fread", "fwrite", "malloc", "calloc", "realloc", "free", "exit", "abort",
    "strlen", "strcpy", "strncpy", "strcmp", "strncmp", "strcat", "strncat",
    "strchr", "strstr", "memcpy", "memmove", "memset", "memcmp", "atoi", "atof",
    "abs", "sqrt", "pow", "qsort", "rand", "srand",
]

# Our own list of standard C and C++ header names ("standard library only").
STD_HEADERS = [
    # C
    "assert.h", "complex.h", "ctype.h", "errno.h", "fenv.h", "float.h",
    "inttypes.h", "iso646.h", "limits.h", "locale.h", "math.h", "setjmp.h",
    "signal.h", "stdalign.h", "stdarg.h", "stdatomic.h", "stdbool.h",
    "stddef.h", "stdint.h", "stdio.h", "stdlib.h", "stdnoreturn.h", "string.h",
    "tgmath.h", "threads.h", "time.h", "uchar.h", "wchar.h", "wctype.h",
    # C++
    "algorithm", "any", "array", "atomic", "bitset", "cassert", "cctype",
    "cerrno", "cfloat", "chrono", "climits", "cmath", "complex",
    "condition_variable", "cstdarg", "cstddef", "cstdint", "cstdio", "cstdlib",
    "cstring", "ctime", "deque", "exception", "forward_list", "fstream",
    "functional", "future", "initializer_list", "iomanip", "ios", "iosfwd",
    "iostream", "istream", "iterator", "limits", "list", "locale", "map",
    "memory", "mutex", "new", "numeric", "optional", "ostream", "queue",
    "random", "ratio", "regex", "set", "sstream", "stack", "stdexcept",
    "streambuf", "string", "string_view", "system_error", "thread", "tuple",
    "type_traits", "typeindex", "typeinfo", "unordered_map", "unordered_set",
    "utility", "valarray", "variant", "vector",
]

# Our own list of words that mark object-oriented C++ content.
OOP_WORDS = ["class", "virtual", "override", "public", "private", "protected",
             "template", "namespace", "new", "delete", "this", "operator",
             "friend"]

# Bracket pairs of the bracket tree used for token distances.
OPEN_BRACKETS = ["(", "[", "{"]
CLOSE_BRACKETS = [")", "]", "}"]

# --- fixed values: the search panel, query -> its token sequence ---
SEARCH_PANEL = {
    "class": ["class"], "struct": ["struct"], "template": ["template"], "namespace": ["namespace"],
    "#include": ["#", "include"], "main()": ["main", "(", ")"], "int main()": ["int", "main", "(", ")"],
    "void main()": ["void", "main", "(", ")"], "if": ["if"], "for": ["for"], "while": ["while"], "switch": ["switch"],
    "try": ["try"], "catch": ["catch"], "throw": ["throw"], "new": ["new"], "delete": ["delete"], "const": ["const"],
    "static": ["static"], "virtual": ["virtual"], "override": ["override"], "public": ["public"], "private": ["private"],
    "protected": ["protected"], "return": ["return"], "typedef": ["typedef"], "enum": ["enum"], "union": ["union"],
    "auto": ["auto"], "nullptr": ["nullptr"],
    "std::vector": ["std", "::", "vector"], "std::string": ["std", "::", "string"], "std::map": ["std", "::", "map"],
    "std::set": ["std", "::", "set"], "std::shared_ptr": ["std", "::", "shared_ptr"],
    "std::unique_ptr": ["std", "::", "unique_ptr"], "std::thread": ["std", "::", "thread"],
    "std::mutex": ["std", "::", "mutex"], "std::cout": ["std", "::", "cout"], "std::cin": ["std", "::", "cin"],
}
