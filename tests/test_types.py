import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlog import types as ty

INT, CHAR = ty.Prim("int"), ty.Prim("char")
_leaf = st.sampled_from([INT, CHAR, ty.UNIT, ty.Prim("ulong", ty.Prim("long")), ty.Var("x"), ty.Nat(3)])
_name = st.sampled_from(["a", "b", "c"])
descs = st.recursive(
    _leaf,
    lambda d: st.one_of(
        d.map(ty.Array),
        st.lists(st.tuples(_name, d), max_size=3).map(lambda x: ty.Record(tuple(x))),
        st.lists(st.tuples(_name, d), max_size=3).map(lambda x: ty.Variant(tuple(x))),
        d.map(lambda t: ty.Recursive("x", t)),
        d.map(lambda t: ty.Fn(("x",), t)),
    ),
    max_leaves=8,
)


def test_text_forms():
    cases = {
        ty.Record((("a", INT),)): "{a:int}",
        ty.tup(INT, CHAR): "(int*char)",
        ty.sum_(INT, CHAR): "(int+char)",
        ty.Array(INT): "[int]",
        ty.FixedArray(INT, ty.Nat(3)): "[:int|3:]",
        ty.list_(INT): "^x.(()+(int*x))",
        ty.enum("A", "B"): "|A, B|",
        ty.Variant((("a", INT), ("b", ty.UNIT))): "|a:int, b|",
    }
    for d, s in cases.items():
        assert ty.text(d) == s


@given(descs)
def test_coding_round_trip(d):
    assert ty.decode(ty.encode(d)) == d
    assert ty.equivalent(d, d)


def test_equivalence():
    assert ty.equivalent(ty.Prim("t", INT), ty.Prim("t"))
    assert not ty.equivalent(INT, CHAR)
    assert ty.equivalent(ty.Recursive("x", ty.Array(ty.Var("x"))), ty.Recursive("y", ty.Array(ty.Var("y"))))
    assert not ty.equivalent(ty.Record((("a", INT),)), ty.Record((("b", INT),)))


def test_functions():
    pair = ty.Fn(("a",), ty.tup(ty.Var("a"), ty.Var("a")))
    assert ty.apply(pair, (INT,)) == ty.tup(INT, INT)
    assert ty.representation(ty.App(pair, (ty.Prim("id", INT),))) == ty.tup(INT, INT)
    with pytest.raises(TypeError):
        ty.apply(pair, (INT, INT))
    with pytest.raises(TypeError):
        ty.apply(INT, ())
    # No capture: the free x of the argument stays free.
    assert ty.free(ty.substitute(ty.Fn(("x",), ty.tup(ty.Var("x"), ty.Var("y"))), {"y": ty.Var("x")})) == {"x"}


def test_flatten_and_layout():
    d = ty.Record((("a", INT), ("b", ty.Record((("c", INT), ("d", ty.tup(INT, INT)))))))
    assert [n for n, _ in ty.flattened(d)] == ["a", "b_c", "b_d_0", "b_d_1"]
    assert [n for n, _ in ty.flattened(INT)] == [""]
    r = ty.Record((("a", ty.Prim("bool")), ("b", ty.Prim("long")), ("c", INT)))
    assert ty.layout(r) == (24, 8)
    assert ty.offsets(r) == [("a", 0), ("b", 8), ("c", 16)]


def test_validation():
    a, b = ("a", INT), ("b", CHAR)
    ty.validate([a, b], [a])  # fewer series than readers
    ty.validate([a, b], [a, b])
    for found, said in (([b], "series 1 is b"), ([("a", CHAR)], r"has type char, expected int"), ([a, b, a], "no reader")):
        with pytest.raises(ValueError, match=said):
            ty.validate([a, b], found)
