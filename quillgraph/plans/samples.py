"""Questions and a small fictional company graph, used by queries, tests and the command line alike."""

from __future__ import annotations

QUESTIONS = [
    (1, "Who founded Ostrava Kilns?"),
    (2, "Where was the founder of Ostrava Kilns born?"),
    (3, "What is the flagship product of Lumen Drift?"),
    (4, "In what year was Lumen Drift founded?"),
    (5, "Where is Harrow Tidal headquartered?"),
    (6, "What is the alma mater of the founder of Lumen Drift?"),
    (7, "Which company acquired Harrow Tidal, and who founded that acquiring company?"),
    (8, "Name a company headquartered in Turku."),
    (9, "Which company is best known for the Mossbox?"),
    (10, "What was the prior employer of the founder of Harrow Tidal?"),
    (11, "Which industry is the company founded by Edda Quill in?"),
    (12, "Give an overview of the kiln market, then relate it to glass and describe each maker in turn please"),
    (13, "Summarize the history. What changed? Why did it change?"),
    (14, "How would you build a tidal plant?"),
    (15, "Who leads the firm and which city is it in that is on the coast of the northern sea today?"),
    (16, "colour of silence"),
    (17, ""),
]

ENTITIES = [
    ("k1", "Ostrava Kilns", "company", ["ostrava"]),
    ("k2", "Lumen Drift", "company", []),
    ("k3", "Harrow Tidal", "company", ["harrow"]),
    ("k4", "Basalt Union", "company", []),
    ("p1", "Edda Quill", "person", []),
    ("p2", "Tomas Rook", "person", []),
    ("p3", "Ines Marl", "person", []),
    ("p4", "Jory Fenn", "person", []),
    ("c1", "Brno", "city", []),
    ("c2", "Turku", "city", []),
]

#: id, subject, predicate, object entity, object value, confidence
FACTS = [
    ("f01", "k1", "was founded by", "p1", None, 0.95),
    ("f02", "p1", "was born in", "c1", None, 0.9),
    ("f03", "p1", "was born in", None, "1971", 0.97),
    ("f04", "k2", "was founded by", "p2", None, 0.92),
    ("f05", "k2", "was founded in", None, "2009", 0.88),
    ("f06", "k2", "has flagship product", None, "Mossbox", 0.91),
    ("f07", "k3", "is headquartered in", "c2", None, 0.93),
    ("f08", "p2", "studied at", None, "Institute of Fjords", 0.86),
    ("f09", "k3", "was acquired by", "k4", None, 0.84),
    ("f10", "k4", "was founded by", "p4", None, 0.9),
    ("f11", "k4", "is headquartered in", None, "Turku", 0.7),
    ("f12", "k3", "was founded by", "p3", None, 0.8),
    ("f13", "p3", "worked at", None, "Grey Harbor Yard", 0.75),
    ("f14", "p1", "founded", "k1", None, 0.9),
    ("f15", "k1", "is", None, "ceramics company", 0.82),
    ("f16", "k1", "was founded by", None, "an unnamed guild", 0.4),
]

#: What the questions above come to, worked out by hand.
ANSWERS = {
    1: ("Edda Quill", ["f01"]),
    2: ("Brno", ["f01", "f02"]),
    3: ("Mossbox", ["f06"]),
    4: ("2009", ["f05"]),
    5: ("Turku", ["f07"]),
    6: ("Institute of Fjords", ["f04", "f08"]),
    7: ("Basalt Union, Jory Fenn", ["f09", "f10"]),
    8: ("Basalt Union, Harrow Tidal", ["f07", "f11"]),
    9: ("Lumen Drift", ["f06"]),
    10: ("Grey Harbor Yard", ["f12", "f13"]),
    11: ("ceramics company", ["f14", "f15"]),
}

#: A model's raw output and the facts that come out of it.
RAW_RESPONSES = [
    (1, '```json\n[{"subject": " Ostrava Kilns ", "predicate": "is", "object_value": "a maker", "confidence": 1.7}]\n```'),
    (2, '{"subject": "A", "predicate": "b", "object": "C"}'),
    (3, '{"subject": "A", "predicate": "b", "object": "C", "confidence": "x"}, {"subject": "D", "predicate": "e", "object_value": 5, "confidence": 0.7}'),
    (4, 'Here you are: [{"subject": "A", "predicate": "b", "object": "C", "confidence": 0.9}, {"subject": "cut", "pred'),
    (5, "nothing to see"),
    (6, '[{"subject": "", "predicate": "b"}, "text", {"subject": "G", "predicate": "h", "object": "I", "confidence": -2}]'),
]
RAW_FACTS = [
    (1, 0, "Ostrava Kilns", "is", None, "a maker", 1.0),
    (2, 0, "A", "b", "C", None, 1.0),
    (3, 0, "A", "b", "C", None, 1.0),
    (3, 1, "D", "e", None, "5", 0.7),
    (4, 0, "A", "b", "C", None, 0.9),
    (6, 0, "G", "h", "I", None, 0.0),
]

MODEL_OUTPUTS = [
    (1, '{"a": "Edda Quill founded it.", "f": ["F1", "F3"]}'),
    (2, '```json\n{"answer": "Brno", "reasoning_steps": [{"fact_id": "F2", "explanation": "born there"}]}\n```'),
    (3, "\n  Mossbox (F6),\nmore"),
    (4, '{"a": "The kiln was lit in spring and the glaze was"'),
    (5, ""),
]
PARSED_OUTPUTS = [(1, "Edda Quill founded it.", ["F1", "F3"]), (2, "Brno", ["F2"]), (3, "Mossbox (F6),", []), (4, MODEL_OUTPUTS[3][1], []), (5, None, [])]

TRUNCATED = [(1, '{"a": "fine"}'), (2, '{"a": "open'), (3, "plain text"), (4, '{"a": "' + "long words and more of them " * 2 + 'Sinkhorn-Knop"}'), (5, '{"a": "one, two, three, four, five, six and seven,"}'), (6, "")]
TRUNCATED_WANT = [(1, False), (2, True), (3, False), (4, True), (5, True), (6, False)]

NEEDLES = [(1, "is located in", "nation_1"), (2, "has segment", "build"), (3, "is part of", "region")]

ANSWER_SAMPLES = [(1, "Turku", "place"), (2, "2009", "year"), (3, "2009", "place"), (4, "with great care", "any"), (5, "silence", "any"), (6, "  ", "any"), (7, "ceramics company", "industry"), (8, "a b c d e f g", "place"), (9, "1850", "year"), (10, "An old maker of fine things", "phrase"), (11, "Of mice", "any"), (12, None, "any")]

LABELLED = [(1, "It was Edda Quill (F1), (F2)"), (2, "Brno [F12];"), (3, "plain"), (4, "F3 and more F4 : "), (5, "")]

GOLD = [(1, "Edda Quill", "edda quill "), (2, "the town of Turku", "Turku"), (3, "no", "yes"), (4, "", "x"), (5, "a b c a", "c d a")]

EVAL_CASES = [
    (1, "Edda Quill founded it", ["edda quill"], "k1 was founded by Edda Quill", ["Edda Quill", "k1"], 120, 10.0),
    (2, "unknown", ["Brno", "1971"], "", ["Brno"], 80, 4.0),
    (3, "Turku or Brno", ["Turku", "Oslo"], "Harrow Tidal in Turku", ["Turku", "Bergen", "Harrow Tidal"], 0, 1.0),
    (4, "anything", [], "", [], 10, 2.5),
]
