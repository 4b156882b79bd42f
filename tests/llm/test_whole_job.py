"""Operators do the whole job: what stands anywhere in a row counts."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

from harrow.llm import language_model, licenses, pii, quality_model


# --- quality classifier -----------------------------------------------------------------


def test_quality_model_learns_from_every_part_of_a_text(spark):
    rng = random.Random(5)
    rows = []
    for i in range(250):
        text = " ".join(rng.choice(["river", "stone", "table", "green", "seven", "music"]) for _ in range(500))[:2400]
        at = 400 * rng.randrange(6) + 270  # six pieces of 255 characters, 400 apart, would all miss it
        rows.append((i, text if i % 2 else text[:at] + "zqxzqxzqxzqx" * 8 + text[at + 96 :], i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality_model.classify(table.select("doc_id", "text"), table.select("doc_id", "quality")).where("held_out").collect()
    marked = [r["score"] for r in out if r["doc_id"] % 2 == 0]
    plain = [r["score"] for r in out if r["doc_id"] % 2]
    assert marked and plain and max(marked) < 0.5 < min(plain)


# --- language model ---------------------------------------------------------------------


def test_language_model_rounds_read_every_run(monkeypatch):
    """What the trainer is given over all rounds: every id of every training text once, the end included."""
    read: list = []
    monkeypatch.setattr(language_model.Trainer, "windows", lambda self, x, y, used, steps=None: read.extend(y[used].tolist()))
    monkeypatch.setattr(language_model, "MIN_STEPS", 0)
    monkeypatch.setattr(language_model, "WINDOWS_AT_HAND", 20)  # several trainings a partition
    words, known = [f"w{i}" for i in range(2000)], language_model.WordIds()
    everyone = list(range(20))
    texts = [" ".join(words[i * 100 : i * 100 + 30 * i + 1]) for i in everyone]
    batch = pa.RecordBatch.from_arrays([pa.array(everyone), pa.array(texts)], ["id", "text"])
    shared = lambda value: type("B", (), {"value": value})
    for turn in range(language_model.ROUNDS):
        list(language_model._train_round(iter([batch]), shared(language_model.new_params()), shared(language_model.read_ranks()), turn))
    want: Counter = Counter()
    for i, t in zip(everyone, texts, strict=True):
        if not language_model.is_held_out(i):
            want.update([*known.of(language_model.words_of(t.encode())), language_model.END])
    assert Counter(read) == want
    assert (language_model.SPAN, language_model.STRIDE) == (32, 24)


# --- personal data ----------------------------------------------------------------------


def test_pii_cues_in_any_case_and_quoted():
    key = "Ab3dEf6hIj9lMn2pQr5t"
    for text, found, kind in [
        ("Social Security Number: 123-45-6789", "123-45-6789", "ssn"), ("pAsSpOrT no. 12345678", "12345678", "account"),
        (f"apiKey={key}", key, "secret"), (f"İß ApiKey: {key}", key, "secret"), (f"API_Key = {key}", key, "secret"),
        (f'{{"password": "{key}"}}', key, "secret"), (f"'api_key' : '{key}'", key, "secret"),
    ]:
        assert [(text[s:e], k) for s, e, k in pii.find(text) if k in pii.ADDED_KINDS] == [(found, kind)], text


# --- licences ---------------------------------------------------------------------------


def test_licenses_wrapped_over_lines(spark):
    rows = [(i, f"The weather on day {i} was mild and the harbour town counted {i * 31} boats") for i in range(300)]
    planted = {
        1000: ("# under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2", ["gpl"]),
        1001: (" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:", ["bsd"]),
        1002: ("CC0 1.0 Universal", ["cc0"]),
        1003: ("Released under the MIT License.\nunder the terms of the GNU\nLesser General Public License as\npublished by the Free Software\nFoundation", ["lgpl", "mit"]),
        1004: ("under the terms of the GNU General Public License as published by\n\nthe Free Software Foundation", ["gpl"]),  # its first line names it
        1006: ("Permission to use, copy, modify, and/or distribute this\n\nsoftware for any purpose with or without fee is hereby granted", []),  # no line does, and a blank line parts them
        1005: ("Released under the MIT License.\nLicensed under the MIT License\nand more", ["mit", "mit"]),
    }
    rows += [(i, f"{rows[i - 1000][1]}\n{t}\n{rows[i - 990][1]}") for i, (t, _) in planted.items()]
    table, paragraphs = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r["row"]: r["id"] for r in table.collect()}
    found = {i: [] for i in planted}
    for r in paragraphs.where("confirmed").collect():
        found[ids[r["row"]]].append(r["family"])
    assert {i: sorted(f) for i, f in found.items()} == {i: f for i, (_, f) in planted.items()}
