import pytest

from docquill.operators.merge import MergeError, checked, merge
from docquill.operators.patch import PatchError, apply_patch, parse_patch
from docquill.operators.pointer import Pointer, PointerError
from docquill.sources.jsontext import canon, parse, render

# RFC 6901, section 5.
DOCUMENT = r'{"foo":["bar","baz"],"":0,"a/b":1,"c%d":2,"e^f":3,"g|h":4,"i\\j":5,"k\"l":6," ":7,"m~n":8}'
POINTERS = {"/foo": '["bar","baz"]', "/foo/0": '"bar"', "/": "0", "/a~1b": "1", "/c%d": "2", "/e^f": "3", "/g|h": "4", "/i\\j": "5", '/k"l': "6", "/ ": "7", "/m~0n": "8", "": DOCUMENT}
FRAGMENTS = {"#": "", "#/foo/0": "/foo/0", "#/c%25d": "/c%d", "#/e%5Ef": "/e^f", "#/g%7Ch": "/g|h", "#/i%5Cj": "/i\\j", "#/k%22l": '/k"l', "#/%20": "/ ", "#/m~0n": "/m~0n"}


def test_pointers():
    root = parse(DOCUMENT)
    for text, expected in POINTERS.items():
        p = Pointer.parse(text)
        assert render(p.resolve(root)) == expected and str(p) == text
    for fragment, text in FRAGMENTS.items():
        assert str(Pointer.parse_fragment(fragment)) == text and Pointer.parse(text).fragment() == fragment


@pytest.mark.parametrize(("text", "code"), [("a", "MissingSlash"), ("/~", "InvalidEscape"), ("/~2", "InvalidEscape")])
def test_pointer_syntax(text, code):
    with pytest.raises(PointerError) as e:
        Pointer.parse(text)
    assert e.value.code == code


@pytest.mark.parametrize("text", ["", "/a", "#/%", "#/%g0", "#/ ", "#/%ff", "#/\u00e9"])
def test_fragment_syntax(text):
    with pytest.raises(PointerError):
        Pointer.parse_fragment(text)


@pytest.mark.parametrize(("text", "code"), [("/x", "MemberNotFound"), ("/a/2", "IndexOutOfRange"), ("/a/-", "InvalidIndex"), ("/a/01", "InvalidIndex"), ("/a/99999999999999999999", "IndexOutOfRange"), ("/n/x", "NotAContainer"), ("/d/k", "DuplicateName")])
def test_pointer_errors(text, code):
    with pytest.raises(PointerError) as e:
        Pointer.parse(text).resolve(parse('{"a":[1,2],"n":1,"d":{"k":1,"k":2}}'))
    assert e.value.code == code


def test_pointer_algebra():
    p = Pointer.parse("/a/b")
    assert p.parent == Pointer.parse("/a") and p.last == "b" and p.append(0) == Pointer.parse("/a/b/0")
    assert Pointer.parse("/a").is_proper_prefix_of(p) and not p.is_proper_prefix_of(p) and Pointer().parent is None


# RFC 6902, appendix A, and further cases: document, patch, result or error code.
PATCHES = [
    ('{"foo":"bar"}', '[{"op":"add","path":"/baz","value":"qux"}]', '{"foo":"bar","baz":"qux"}'),
    ('{"foo":["bar","baz"]}', '[{"op":"add","path":"/foo/1","value":"qux"}]', '{"foo":["bar","qux","baz"]}'),
    ('{"baz":"qux","foo":"bar"}', '[{"op":"remove","path":"/baz"}]', '{"foo":"bar"}'),
    ('{"foo":["bar","qux","baz"]}', '[{"op":"remove","path":"/foo/1"}]', '{"foo":["bar","baz"]}'),
    ('{"baz":"qux","foo":"bar"}', '[{"op":"replace","path":"/baz","value":"boo"}]', '{"baz":"boo","foo":"bar"}'),
    ('{"foo":{"bar":"baz","waldo":"fred"},"qux":{"corge":"grault"}}', '[{"op":"move","from":"/foo/waldo","path":"/qux/thud"}]', '{"foo":{"bar":"baz"},"qux":{"corge":"grault","thud":"fred"}}'),
    ('{"foo":["all","grass","cows","eat"]}', '[{"op":"move","from":"/foo/1","path":"/foo/3"}]', '{"foo":["all","cows","eat","grass"]}'),
    ('{"baz":"qux","foo":["a",2,"c"]}', '[{"op":"test","path":"/baz","value":"qux"},{"op":"test","path":"/foo/1","value":2.0}]', '{"baz":"qux","foo":["a",2,"c"]}'),
    ('{"baz":"qux"}', '[{"op":"test","path":"/baz","value":"bar"}]', "TestFailed"),
    ('{"foo":"bar"}', '[{"op":"add","path":"/child","value":{"g":{}}}]', '{"foo":"bar","child":{"g":{}}}'),
    ('{"foo":"bar"}', '[{"op":"add","path":"/baz","value":"qux","xyz":123}]', '{"foo":"bar","baz":"qux"}'),
    ('{"foo":"bar"}', '[{"op":"add","path":"/baz/bat","value":"qux"}]', "PathNotFound"),
    ('{"/":9,"~1":10}', '[{"op":"test","path":"/~01","value":10}]', '{"/":9,"~1":10}'),
    ('{"/":9,"~1":10}', '[{"op":"test","path":"/~01","value":"10"}]', "TestFailed"),
    ('{"foo":["bar"]}', '[{"op":"add","path":"/foo/-","value":["abc","def"]}]', '{"foo":["bar",["abc","def"]]}'),
    ('{"a":1}', '[{"op":"add","path":"","value":[]}]', "[]"),
    ('{"a":1}', '[{"op":"replace","path":"","value":null}]', "null"),
    ('{"a":1}', '[{"op":"remove","path":""}]', "RootRemoved"),
    ('{"a":{"b":1}}', '[{"op":"move","from":"/a","path":"/a/b"}]', "MoveIntoChild"),
    ('{"a":{"b":1}}', '[{"op":"move","from":"","path":"/a"}]', "MoveIntoChild"),
    ('{"a":1}', '[{"op":"move","from":"/a","path":"/a"}]', '{"a":1}'),
    ('{"a":1}', '[{"op":"move","from":"/x","path":"/x"}]', "FromNotFound"),
    ('{"a":{"b":[1]}}', '[{"op":"copy","from":"/a/b","path":"/c"},{"op":"add","path":"/c/0","value":0}]', '{"a":{"b":[1]},"c":[0,1]}'),
    ('{"a":1}', '[{"op":"copy","from":"/a","path":""}]', "1"),
    ('[1]', '[{"op":"add","path":"/2","value":0}]', "PathNotFound"),
    ('[1]', '[{"op":"add","path":"/x","value":0}]', "PathNotFound"),
    ('[1]', '[{"op":"replace","path":"/1","value":0}]', "PathNotFound"),
    ('[1]', '[{"op":"replace","path":"/-","value":0}]', "PathNotFound"),
    ('1', '[{"op":"add","path":"/a","value":0}]', "PathNotFound"),
    ('{"a":1}', '{"op":"remove"}', "NotAnArray"),
    ('{"a":1}', "[1]", "NotAnObject"),
    ('{"a":1}', '[{"path":"/a"}]', "MissingMember"),
    ('{"a":1}', '[{"op":"remove"}]', "MissingMember"),
    ('{"a":1}', '[{"op":"add","path":"/a"}]', "MissingMember"),
    ('{"a":1}', '[{"op":"copy","path":"/a"}]', "MissingMember"),
    ('{"a":1}', '[{"op":"spam","path":"/a"}]', "UnknownOperation"),
    ('{"a":1}', '[{"op":1,"path":"/a"}]', "NotAString"),
    ('{"a":1}', '[{"op":"remove","path":"a"}]', "InvalidPointer"),
    ('{"a":1}', '[{"op":"remove","path":"/a","path":"/b"}]', "DuplicateMember"),
    ('{"a":1,"a":2}', '[{"op":"remove","path":"/a"}]', "PathNotFound"),
]


@pytest.mark.parametrize(("text", "patch", "expected"), PATCHES)
def test_patches(text, patch, expected):
    root = parse(text)
    try:
        got = render(apply_patch(root, parse_patch(parse(patch))))
    except PatchError as e:
        got = e.code
    assert got == expected and render(root) == text


# RFC 7396, appendix A.
MERGES = [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'),
    ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"c"}', '{"a":["b"]}', '{"a":["b"]}'), ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'),
    ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"a":"b"}', '["c"]', '["c"]'), ('{"a":"foo"}', "null", "null"), ('{"a":"foo"}', '"bar"', '"bar"'),
    ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
    ("3", '{"b":[null,{"x":null}],"c":{"d":null,"e":1}}', '{"b":[null,{"x":null}],"c":{"e":1}}'), ('{"a":1,"b":2,"c":3}', '{"b":9,"d":4,"a":null}', '{"b":9,"c":3,"d":4}'),
]


@pytest.mark.parametrize(("target", "patch", "expected"), MERGES)
def test_merges(target, patch, expected):
    root = parse(target)
    assert render(merge(root, checked(parse(patch)))) == expected and render(root) == target


def test_merge_errors():
    with pytest.raises(MergeError):
        checked(parse('{"a":{"b":1,"b":2}}'))
    with pytest.raises(MergeError):
        merge(parse('{"a":1,"a":2}'), parse('{"b":1}'))
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert canon(merge(parse("{}"), checked(parse(deep)))) == canon(parse(deep))
