"""Alignment flags and the columns of the alignments relation."""

from pyspark.sql import types as T

# The flag bits of the alignment format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 1, 2, 4, 8
REVERSE, MATE_REVERSE, READ1, READ2 = 16, 32, 64, 128
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

READS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("tid", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("mtid", T.IntegerType()),
        T.StructField("mpos", T.IntegerType()),
        T.StructField("tlen", T.IntegerType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("rg", T.StringType()),
        T.StructField("rx", T.StringType()),
        # rg and rx are the tags RG and RX as columns of their own; writers put them in the place of those.
        T.StructField("tags", T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))),
    ]
)
