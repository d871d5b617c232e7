"""The closed vocabulary of structural tokens, as lists, as a table and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_SLOTS = FIELD_SLOTS = 64

# The ids of the tokens are their places in these lists.
ATOMS = """
BOS EOF PAD
INT_LIT FLOAT_LIT IMAG_LIT CHAR_LIT STRING_LIT LIT_UNK
EMPTY_STMT ELLIPSIS
CHAN_SEND CHAN_RECV CHAN_BI
BR_BREAK BR_CONTINUE BR_GOTO BR_FALLTHROUGH BR_UNK
NAME_BLANK NAME_UNK NAME_OVF
FIELD_OVF
OP_ADD OP_SUB OP_MUL OP_QUO OP_REM
OP_AND OP_OR OP_XOR OP_SHL OP_SHR OP_ANDNOT
OP_LAND OP_LOR OP_ARROW OP_INC OP_DEC
OP_EQL OP_NEQ OP_LSS OP_GTR OP_LEQ OP_GEQ OP_NOT
OP_ASSIGN OP_DEFINE
OP_ADD_ASSIGN OP_SUB_ASSIGN OP_MUL_ASSIGN
OP_QUO_ASSIGN OP_REM_ASSIGN
OP_AND_ASSIGN OP_OR_ASSIGN OP_XOR_ASSIGN
OP_SHL_ASSIGN OP_SHR_ASSIGN OP_ANDNOT_ASSIGN
OP_UNK
BI_LEN BI_CAP BI_PANIC BI_RECOVER BI_MAKE BI_NEW
BI_APPEND BI_COPY BI_DELETE BI_CLOSE
BI_COMPLEX BI_REAL BI_IMAG BI_PRINT BI_PRINTLN
BI_NIL BI_TRUE BI_FALSE BI_IOTA
T_BOOL T_BYTE T_RUNE T_STRING
T_INT T_INT8 T_INT16 T_INT32 T_INT64
T_UINT T_UINT8 T_UINT16 T_UINT32 T_UINT64 T_UINTPTR
T_FLOAT32 T_FLOAT64 T_COMPLEX64 T_COMPLEX128
T_ERROR T_ANY T_COMPARABLE
""".split()
PAIRED = """
FUNC_DECL RECV
FUNC_TYPE TYPE_PARAMS PARAMS RESULTS
GEN_DECL VAR_DECL CONST_DECL TYPE_DECL
VALUE_SPEC TYPE_SPEC
STRUCT_TYPE INTERFACE_TYPE
ARRAY_TYPE MAP_TYPE CHAN_TYPE ELLIPSIS_TYPE
FIELD
BLOCK EXPR_STMT
ASSIGN INCDEC RETURN BRANCH
IF ELSE FOR RANGE
SWITCH TYPE_SWITCH CASE
SELECT COMM_CLAUSE
GO DEFER SEND LABELED
BINOP UNARY STAR
SELECTOR INDEX INDEX_LIST SLICE TYPE_ASSERT
CALL KV COMPOSITE_LIT FUNC_LIT
""".split()

TOKENS = [
    *ATOMS,
    *(f"{side}_{kind}" for kind in PAIRED for side in ("OPEN", "CLOSE")),
    *(f"NAME_{i}" for i in range(NAME_SLOTS)),
    *(f"FIELD_{i}" for i in range(FIELD_SLOTS)),
]
IDS = {token: i for i, token in enumerate(TOKENS)}
if len(IDS) != len(TOKENS):
    raise RuntimeError("a token is in the vocabulary twice")
CLOSES = {IDS[f"OPEN_{k}"]: IDS[f"CLOSE_{k}"] for k in PAIRED}


def table(spark: SparkSession) -> DataFrame:
    """id, token: a row for each token."""
    return spark.createDataFrame(list(enumerate(TOKENS)), "id int, token string")


def pairs(spark: SparkSession) -> DataFrame:
    """open_id, close_id of each kind of bracket."""
    return spark.createDataFrame(list(CLOSES.items()), "open_id int, close_id int")


def duplicates(vocabulary: DataFrame) -> DataFrame:
    """token, count of tokens that a vocabulary has more than once."""
    return vocabulary.groupBy("token").count().filter("count > 1")


def _map(of: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def encode(tokens: Column) -> Column:
    """The ids of an array of tokens; unknown tokens are dropped. The map folds to a constant, which
    is searched from its begin for each token: for short arrays of a table. Where tokens are made,
    tokenize.tokenized_ids() numbers them by a dictionary."""
    return F.filter(F.transform(tokens, lambda t: F.try_element_at(_map(IDS), t)), lambda i: i.isNotNull())


def unknown(tokens: Column) -> Column:
    """The tokens of an array that are not in the vocabulary."""
    return F.array_except(tokens, F.array(*map(F.lit, TOKENS)))


def _by_place(closes: dict[int, int], x: Column) -> tuple[Column, Column]:
    """(the closing symbol of x or null, whether x is one) for symbols that are small numbers, each
    found by its place in an array."""
    size = max((*closes, *closes.values())) + 1
    shuts = set(closes.values())
    close = F.get(F.array(*(F.lit(closes.get(i)).cast("int") for i in range(size))), x)
    return close, F.coalesce(F.get(F.array(*(F.lit(i in shuts) for i in range(size))), x), F.lit(False))


def _by_search(closes: dict[str, str], x: Column) -> tuple[Column, Column]:
    return F.try_element_at(_map(closes), x), F.array_contains(F.array(*(F.lit(v) for v in closes.values())), x)


def balance(symbols: Column, closes: dict) -> Column:
    """(rate, strict) of an array of symbols under a map from opening to closing ones.

    The rate is the share of openings whose closing stands where it should: a closing symbol takes
    the innermost opening off the stack, and counts if it is its own; one on an empty stack is
    free; without openings the rate is 1. Strict is whether all match and none is left open."""
    text = isinstance(next(iter(closes)), str)
    empty = F.array().cast("array<string>" if text else "array<int>")
    zero = F.struct(empty.alias("stack"), F.lit(0).alias("ok"), F.lit(0).alias("total"), F.lit(False).alias("bad"))

    def step(s: Column, x: Column) -> Column:
        close, shuts = (_by_search if text else _by_place)(closes, x)
        top, depth = F.try_element_at(s["stack"], F.lit(-1)), F.size(s["stack"])
        own = F.coalesce(top == x, F.lit(False))
        shut = F.struct(F.slice(s["stack"], 1, F.greatest(depth - 1, F.lit(0))).alias("stack"), (s["ok"] + own.cast("int")).alias("ok"), s["total"].alias("total"), (s["bad"] | ~own).alias("bad"))
        opened = F.struct(F.concat(s["stack"], F.array(close)).alias("stack"), s["ok"].alias("ok"), (s["total"] + 1).alias("total"), s["bad"].alias("bad"))
        return F.when(close.isNotNull(), opened).when(shuts, shut).otherwise(s)

    return F.aggregate(
        symbols, zero, step,
        lambda s: F.struct(F.when(s["total"] == 0, F.lit(1.0)).otherwise(s["ok"] / s["total"]).alias("rate"), (~s["bad"] & (F.size(s["stack"]) == 0)).alias("strict")),
    )
