import numpy as np

from gondola.llm import langid


def test_every_character_keeps_its_symbol(spark):
    """More than 4094 characters, the rarest of which alone tell two languages apart."""
    rng, common = np.random.default_rng(4), [chr(0x4E00 + k) for k in range(4200)]
    rare = {"xa": [chr(0xAC00 + k) for k in range(0, 600)], "xb": [chr(0xAC00 + k) for k in range(600, 1200)]}
    rows = [(k, "".join(common) * 3, "zh") for k in range(60)]
    for lang, letters in rare.items():
        rows += [(len(rows) + k, "".join(rng.permutation(letters)), lang) for k in range(60)]
    model = langid.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(map(ord, common)) <= set(model.alphabet.tolist()) and len(model.alphabet) == 5400
    texts = ["".join(rng.permutation(letters)) for letters in rare.values() for _ in range(20)]
    assert model.predict(texts)[0] == ["xa"] * 20 + ["xb"] * 20
