"""A Python data source for the tests, registered by name."""

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Tides(DataSource):
    """A source of its own, without options or paths."""

    @classmethod
    def name(cls):
        return "tides"

    def schema(self):
        return "id int, metres double"

    def reader(self, schema):
        class Tide(DataSourceReader):
            def partitions(self):
                return [InputPartition(k) for k in range(3)]

            def read(self, partition):
                yield from ((partition.value * 10 + i, i / 2) for i in range(5))

        return Tide()
