"""Both ends of connections: pairing, attribution to processes, asymmetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def established(entries: DataFrame) -> DataFrame:
    """One row: how many sockets are established, whatever the port."""
    return entries.agg(F.count_if(F.col("state") == "ESTABLISHED").alias("established"))


def listening(entries: DataFrame) -> DataFrame:
    """Ports with a listener."""
    return entries.where("state = 'LISTEN'").select(F.col("local_port").alias("port")).distinct()


def pair_connections(entries: DataFrame) -> DataFrame:
    """Each established socket with the socket at its other end.

    entries: seq, local_ip, local_port, remote_ip, remote_port, state, inode.  The peer has local and
    remote exchanged; of several the first by seq.  peer_inode is null where the other end is not in
    the table.
    """
    live = entries.where("state = 'ESTABLISHED'")
    order = Window.partitionBy("local_ip", "local_port", "remote_ip", "remote_port").orderBy("seq")
    first = live.withColumn("n", F.row_number().over(order)).where("n = 1")
    other = first.select(F.col("remote_ip").alias("local_ip"), F.col("remote_port").alias("local_port"), F.col("local_ip").alias("remote_ip"), F.col("local_port").alias("remote_port"), F.col("inode").alias("peer_inode"))
    keys = ["local_ip", "local_port", "remote_ip", "remote_port"]
    return live.join(other, keys, "left").select("seq", *keys, "inode", "peer_inode")


@dataclass(frozen=True)
class PeerSummary:
    processes: DataFrame
    pairs: DataFrame
    totals: DataFrame


def summarise(pairs: DataFrame, owners: DataFrame, listen: DataFrame, port: int | None = None, threshold: int = 10) -> PeerSummary:
    """Ends by process and connections by pair of owning processes.

    owners: inode, pid, comm (one per inode).  An end is a server's if its local port has a
    listener, else a client's.  A process is flagged where its client ends exceed its server ends by
    the threshold.  A connection between two owners counts once; its label is the server's side with its
    port, then the client's.
    """
    if port is not None:
        pairs = pairs.where((F.col("local_port") == port) | (F.col("remote_port") == port))
    own = owners.select("inode", "pid", "comm")
    peer = owners.select(F.col("inode").alias("peer_inode"), F.col("pid").alias("peer_pid"), F.col("comm").alias("peer_comm"))
    ends = pairs.join(own, "inode", "left").join(peer, "peer_inode", "left").join(listen.select(F.col("port").alias("local_port"), F.lit(True).alias("serves")), "local_port", "left")
    serves = F.coalesce("serves", F.lit(False))
    totals = ends.agg(F.count_if(F.col("pid").isNotNull()).alias("attributed"), F.count_if(F.col("pid").isNull()).alias("unattributed"), F.count_if(F.col("peer_inode").isNull()).alias("external"))
    processes = ends.where("pid is not null").groupBy("pid").agg(F.min_by("comm", "seq").alias("comm"), F.count_if(~serves).alias("client_end"), F.count_if(serves).alias("server_end"), F.count_if(F.col("peer_inode").isNull()).alias("external"))
    flagged = (F.col("client_end") - F.col("server_end") >= threshold) & (F.col("client_end") >= threshold)
    processes = processes.withColumn("flagged", flagged).orderBy(F.desc(F.col("client_end") + F.col("server_end")), F.desc(F.col("client_end") - F.col("server_end")), "pid")
    label = lambda pid, comm: F.concat(F.when(F.col(comm) != "", F.col(comm)).otherwise("?"), F.lit("("), F.col(pid), F.lit(")"))
    mine, theirs = label("pid", "comm"), label("peer_pid", "peer_comm")
    port_of = lambda c: F.concat(F.lit(" :"), F.col(c).cast("string"))
    server = F.when(serves, F.concat(mine, port_of("local_port"))).otherwise(F.concat(theirs, port_of("remote_port")))
    client = F.when(serves, theirs).otherwise(mine)
    # of a connection's two ends the first in table order names it
    both = ends.where("pid is not null and peer_pid is not null").select(F.least("inode", "peer_inode").alias("x"), F.greatest("inode", "peer_inode").alias("y"), "seq", F.concat(server, F.lit("  <->  "), client).alias("label"))
    once = both.groupBy("x", "y").agg(F.min_by("label", "seq").alias("label"))
    by_owner = once.groupBy("label").agg(F.count(F.lit(1)).alias("connections")).orderBy(F.desc("connections"), "label")
    return PeerSummary(processes, by_owner, totals)
