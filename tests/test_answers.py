from folium.models import answers


def test_failed_anchored_pages_are_asked_again(spark):
    def model():
        def answer(prompt, image):
            if "Transcript" in prompt or image == b"bad":
                raise ValueError("no")
            return f"{prompt} {len(image)}"

        return answer

    rows = [("a", 1, "s", b"12", None), ("b", 1, "s", b"123", "text"), ("c", 1, "s", b"bad", "text")]
    pages = spark.createDataFrame(rows, "document_id string, page int, source string, image binary, transcript string")
    got = {r.document_id: (r.text, r.error, r.retried) for r in answers.ask(pages, model, "Read.").collect()}
    assert got == {"a": ("Read. 2", None, False), "b": ("Read. 3", None, True), "c": (None, "no", True)}


def test_cleaning_and_probe(spark):
    texts = spark.createDataFrame([(" ",), ("x",)], "text string")
    got = {r.text: (r.cleaned, r.seconds == 0) for r in answers.clean_texts(texts, lambda: lambda p, i: p.upper(), "p").collect()}
    assert got[" "] == (" ", True) and got["x"][0] == "P\nX"
    probe = answers.round_trips(texts, lambda: (lambda t: list(t.encode()), lambda ids: bytes(ids).decode()))
    assert all(r.round_trip for r in probe.collect())
