"""Templates over values and rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions import templates
from quire.functions.templates import Template
from quire.plans import samples
from quire.sources import books as source

BOOK = {"Title": "T", "Authors": [{"LastName": "Lee", "FirstName": "Ann", "Nickname": ""}, {"LastName": "", "FirstName": "", "Nickname": "bo"}], "Series": [], "Language": "ru", "N": 3}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a {{ .Title }} b", "a T b"),
        ("a {{- .Title -}} b", "aTb"),
        ("{{ if gt (len .Authors) 1 }}many{{ else }}one{{ end }}", "many"),
        ("{{ if .Series }}s{{ else if .Language }}l{{ else }}n{{ end }}", "l"),
        ('{{ range $i, $a := .Authors }}{{ if $i }}, {{ end }}{{ or $a.LastName $a.Nickname }}{{ end }}', "Lee, bo"),
        ("{{ range .Series }}x{{ else }}none{{ end }}", "none"),
        ('{{ $p := "" }}{{ with first .Authors }}{{ $p = .LastName }}{{ end }}{{ $p }} - {{ .Title }}', "Lee - T"),
        ('{{ printf "%s/%03d" (.Title | lower) .N }}', "t/003"),
        ('{{ .Missing | default "d" | upper }}', "D"),
        ('{{ eq .Language "en" "ru" }} {{ not .Series }} {{ (index .Authors 1).Nickname }}', "true true bo"),
        ('{{/* no */}}{{ trunc 2 "abc" }}{{ "q\\"x" }}', 'abq"x'),
        ("{{ $.Title }}{{ with .N }}{{ . }}{{ $.Title }}{{ end }}", "T3T"),
    ],
)
def test_values(text, want):
    assert Template(text).render(BOOK) == want


@pytest.mark.parametrize("text", ["{{ if .A }}", "{{ end }}", "{{ if .A }}{{ else }}"])
def test_errors(text):
    with pytest.raises(ValueError):
        Template(text).render({})
    with pytest.raises(ValueError):
        Template("{{ nosuch 1 }}").render({})


def test_rows(spark):
    turns = spark.createDataFrame([(7, 0, "user", "hi"), (8, 0, "user", "ho")], "conv_id long, turn long, role string, text string")
    books = source.metadata(samples.conversation_books(turns))
    t = templates.output_names(books, '{{ (first .Authors).LastName }}/{{ .Title }}{{ range .Series }} {{ .Name }}-{{ .Number }}{{ end }} {{ join "+" .Genres }}', "epub3").orderBy("book_id")
    assert [(r.book_id, r.name) for r in t.collect()] == [("7", "L2/Talk 7 Talks-7 sf+talk"), ("8", "L3/Talk 8 Talks-8 sf+talk")]
    assert [r.name for r in templates.output_names(books, "{{ nosuch }}", "md").orderBy("book_id").collect()] == ["7", "8"]
    assert [r.name for r in templates.output_names(books, "{{ if }", "md").orderBy("book_id").collect()] == ["{{ if }"] * 2
    notes = spark.createDataFrame([(1, 2, "Notes", None)], "body_number int, note_no int, body_title string, title string")
    assert templates.note_labels(notes, "{{ .BodyNumber }}.{{ .NoteNumber }}{{ if .NoteTitle }} {{ .NoteTitle }}{{ end }}", "pdf").first().label == "1.2"
    people = spark.createDataFrame([("A", None, "B", "n", 0), (None, None, None, "n", 1)], "first string, middle string, last string, nickname string, i int")
    assert [r.name for r in templates.person_names(people, "{{ .LastName }} {{ .FirstName }}", "pdf", "i", F.col("nickname")).collect()] == ["B A", "n"]
    refs = spark.createDataFrame([(3,), (0,)], "page int")
    page = {"PageNumber": F.col("page")}
    assert [r.text for r in templates.backlink_texts(refs, "{{ if .PageNumber }}p. {{ .PageNumber }}{{ end }}", page).collect()] == ["p. 3", "[<]"]
    assert [r.text for r in templates.backlink_texts(refs, " ", page).collect()] == ["[<]"] * 2
    assert templates.expanded(refs.limit(0), "{{ .PageNumber }}", page, "x").collect() == []
