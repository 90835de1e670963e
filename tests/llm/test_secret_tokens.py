"""Random keys behind '=' and of letters alone are found; long words are not."""
import random
import string

from ledgerspark.llm import secrets

R = random.Random(23)
WORDS = ("internationalization", "INTERNATIONALIZATION", "SOME-THING-IN-CAPITAL-LETTERS", "THIS_IS_A_LONG_CONSTANT_NAME",
         "getElementsByClassNameAndTag", "src/main/java/com/example/Application", "-" * 40, "12345678901234567890123",
         "aws_secret_access_key_of_ours=", "=" * 30)


def key(n, chars=string.ascii_letters + string.digits):
    return "".join(R.choice(chars) for _ in range(n))


def test_keys_by_place_and_letters(spark):
    full, letters = key(40, string.ascii_letters + string.digits + "+/"), key(32, string.ascii_letters)
    padded = key(42) + "=="
    cases = [("aws_secret_access_key=", full, ""), ("AUTH=", key(40), ""), ("sig=", padded, " x"), ("https://a.example/p?session=", key(32), "&n=1"),
             ("https://a.example/p?n=1&sig=", padded, "&m=2"), ("take ", letters, " now"), ("AUTH=", letters, ";"), ("x = '", key(40), "'"),
             ("A==", key(40), "=rest"), ("CONFIGURATION_OF_THE_SERVICE=", key(40), "")]
    texts = [a + k + b for a, k, b in cases] + list(WORDS)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_digest(df).collect()}
    for i, (a, k, _) in enumerate(cases):
        assert got[i] == f"random:{len(a)}:{len(a) + len(k)}", texts[i]
    assert [got[len(cases) + i] for i in range(len(WORDS))] == [""] * len(WORDS)
