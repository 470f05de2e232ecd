"""Contexts of finds by position, and values that only a second hop reaches."""

import random

from meterstone.llm.context_pii import find_pii, mask_pii


def added(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.spans if not s.base] for r in find_pii(table).collect()}


def test_accepted_values_bring_in_patterns(spark):
    seeds = [f"Please call me at +1 (555) 010-0{i:03d} today" for i in range(12)]
    linking = [f"Please call me at 555-01{i:02d}-77 today" for i in range(5)]
    # No base find stands in this context, only values of the hop before.
    again = [f"his private extension 555-01{i:02d}-77 was busy" for i in range(5)]
    unseen = ["his private extension 555-0942-11 was busy"]
    got = added(spark, [*seeds, *linking, *again, *unseen, "the order number 777-0001-88 came"])
    assert [got[i] for i in range(12, 22)] == 2 * [[f"555-01{i:02d}-77"] for i in range(5)]
    assert got[22] == ["555-0942-11"] and got[23] == []


def test_words_with_digits_are_context(spark):
    seeds = [f"Line 2: +1 (555) 010-0{i:03d} (day)" for i in range(12)]
    got = added(spark, [*seeds, "Line 2: 555-0100-77 (day)"])
    assert got[12] == ["555-0100-77"]


def test_neighbours_and_punctuation(spark):
    seeds = [f"desk 4b or +1 (555) 010-0{i:03d}, room" for i in range(12)]
    got = added(spark, [*seeds, "desk 4b or 555-0100-77, room"])
    assert got[12] == ["555-0100-77"]


def test_a_single_word_is_a_context(spark):
    seeds = [f"Phone +1 (555) 010-0{i:03d} daily" for i in range(12)]
    got = added(spark, [*seeds, "Phone 555-0100-77 daily"])
    assert got[12] == ["555-0100-77"]


def test_secrets_by_what_they_are_called(spark):
    rng = random.Random(3)

    def key(n):
        # Four digits or more make a candidate.
        return "".join(rng.choice("0123456789abcdef") for _ in range(n - 6)) + "a01b23"

    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    forms = ['token = "{}"', "API_KEY={}", '"password": "{}",', "Authorization: Bearer {}", "the secret is {}."]
    secrets = [key(40 if i % 2 else 90) for i in range(50)]
    texts = [f"{prose(30)} {forms[i % 5].format(v)} {prose(30)}" for i, v in enumerate(secrets)]
    # Of another shape: only their contexts tell, of which they are a minor part.
    short = [f"{rng.randrange(10**4):04d}-{rng.randrange(10**4):04d}/x" for _ in range(4)]
    texts += [f'{prose(10)} token = "{v}" {prose(9)}' for v in short]
    clean = [f"{prose(20)} order {rng.randrange(10**8):08d} of {key(40)} came {prose(5)} token = none" for _ in range(40)]
    got = added(spark, texts + clean)
    wanted = secrets + short
    found = sum(got[i] == [v] for i, v in enumerate(wanted))
    assert found == len(wanted)
    assert all(not got[len(wanted) + i] for i in range(len(clean)))


def test_a_secret_is_masked_wherever_it_stands(spark):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{value}"'), (2, f"({value}) again"), (3, "nothing"), (4, None)]
    out = mask_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {1: 'token = "[SECRET]"', 2: "([SECRET]) again", 3: "nothing", 4: None}


def test_numbers_beside_a_find_do_not_split_patterns(spark):
    seeds = [f"Line {i}: +1 (555) 010-0{i:03d} (day)" for i in range(12)]
    got = added(spark, [*seeds, "Line 99: 555-0100-77 (day)"])
    assert got[12] == ["555-0100-77"]


def test_what_is_quoted_ends_with_its_quotes(spark):
    value = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"
    texts = [f'word%%% token = "{value}"### nicht### es', f"passwd='{value}';x", f'secret: "{value.upper()}"!! A']
    assert added(spark, texts) == {0: [value], 1: [value], 2: [value.upper()]}
