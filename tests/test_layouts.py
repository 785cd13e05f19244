"""File layouts with the dirty cases of the samples (synthetic text, layouts only)."""
import json

from pyspark.sql import functions as F

from colloquy.operators import dialogue as D
from colloquy.sources import files as Fi

UTTERANCES = '''Utterance,Sub topic,ID,Type,Dialogue_Act,Emotion
"Hello, how are you today?",greeting,1,T,question,
I am fine thank you.,greeting,2,P,answer,
"I sleep, badly",sleep,3,P,,sad
A note on the visit,summary,,,,
Another note,Summary,,,,
Final note,summary ,,,,
sleep,primary_topic,,,,
mood,secondary_topic,,,,
moods,secondary_topc,,,,
Tell me more.,sleep,4,,probe,
'''


def test_utterance_csv_and_metadata_split(spark, tmp_path):
    d = tmp_path / "split=Train" / "note=7"
    d.mkdir(parents=True)
    (d / "SummAnnotated - 7.csv").write_text(UTTERANCES, encoding="utf-8")
    rows = Fi.read_utterance_csv(spark, str(tmp_path))
    assert rows.count() == 10
    r = {x["row"]: x for x in rows.collect()}
    assert r[0]["Utterance"] == "Hello, how are you today?" and r[2]["Utterance"] == "I sleep, badly"
    assert r[2]["Dialogue_Act"] is None and r[0]["Emotion"] is None and r[9]["Type"] is None
    turns, notes = D.split_metadata(rows, "Sub_topic", "Utterance", "row", key="note")
    assert notes.first()["summary"] == "Final note"                 # last summary variant wins
    kept = [x["Utterance"] for x in turns.orderBy("row").collect()]
    assert kept == ["Hello, how are you today?", "I am fine thank you.", "I sleep, badly", "moods", "Tell me more."]
    roles = [x["r"] for x in turns.orderBy("row").select(D.role_from_type(F.col("Type")).alias("r")).collect()]
    assert roles == ["Doctor", "Patient", "Patient", "Doctor", "Doctor"]   # misspelt topic row is a Doctor turn


def test_transcript_json_array(spark, tmp_path):
    d = tmp_path / "conv_id=3"
    d.mkdir()
    doc = [{"speaker": 1, "dialogue": ["Hi.", "How do you feel?"]},
           {"speaker": 2, "dialogue": ["Tired today."]},
           {"speaker": 1, "dialogue": ["I see."]}]
    (d / "D0000-S1-T01.json").write_text(json.dumps(doc), encoding="utf-8")
    r = Fi.read_transcripts(spark, str(tmp_path)).orderBy("_pos").collect()
    assert [x["speaker"] for x in r] == [1, 2, 1] and all(x["conv_id"] == 3 for x in r)
    assert sum(len(x["dialogue"]) for x in r) == 4 and " " in r[1]["dialogue"][0]


def test_export_keeps_whole_value_and_prompts(spark, tmp_path):
    d = tmp_path / "conv_id=5"
    d.mkdir()
    lines = ["0\t1\tEllie\tintro (how are you doing today)", "1\t2\tParticipant\tfine, thanks",
             "2\t3\tEllie\t<sync>", "3\t4\tEllie\tokay"]
    (d / "part-0.csv").write_text("\n".join(f"{x}\t{i}" for i, x in enumerate(lines)) + "\n", encoding="utf-8")
    rows = Fi.read_export(spark, str(tmp_path)).withColumnRenamed("speaker", "speaker_name")
    text = D.interview_dialogue(rows).first()["dialogue"]
    assert text == "Doctor: how are you doing today\nPatient: fine, thanks.\nDoctor: okay.\n"
