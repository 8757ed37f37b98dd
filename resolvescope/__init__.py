"""Spark-native analytics for the population of recursive DNS resolvers and forwarders."""
