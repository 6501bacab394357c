"""Numbers with brackets: those that are open in the number stay, those that nothing opens go."""

import pytest
from pyspark.sql import functions as F

from tamarack.functions import contacts


@pytest.mark.parametrize("given,want", [("+1 (040) 555-0631", "+1 (040) 555-0631"), ("0)30 12345678", "030 12345678"), ("+49 ( 0 )30 123456", "+49 (0)30 123456"), ("+49 (0)30 (120) 0)5", "+49 (0)30 (120) 05")])
def test_brackets(spark, given, want):
    assert spark.range(1).select(contacts.normalize_phone(F.lit(given)).alias("p")).first().p == want
