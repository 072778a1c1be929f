from pyspark.sql import functions as F

from conftest import SF
from tidepool.operators import diagnostics as D
from tidepool.plans import q_diagnostics as Q
from tidepool.sources import cluster


def test_marked_sections_give_the_recommendations_of_all_sections(spark):
    whole, marked = (D.recommendations(Q._sections(spark, SF, build)).select("id", "rule_order") for build in (D.sections, D.marked_sections))
    assert marked.columns == ["id", "rule_order"] and whole.count() > 0
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, marked.collect()))


def test_marked_sections_shuffle_no_texts(spark):
    """beside the names, joins get bits; no text of a pod, an event or a status is in their output."""
    rows = Q._sections(spark, SF, D.marked_sections)
    assert rows.columns == ["id", "section", "position", "marks"]
    assert rows.where("section <> 'status' and marks = 0").count() == 0


def test_documents_come_with_the_name_they_are_chosen_by(spark):
    """a listing picks and cuts documents by a column, not by parsing their text."""
    docs = cluster.cr_file_documents(spark, SF, keep=("name",))
    assert docs.columns == ["doc", "name"] and cluster.cr_file_documents(spark, SF).columns == ["doc"]
    assert docs.where(F.get_json_object("doc", "$.metadata.name") != F.col("name")).count() == 0 and docs.count() > 0
