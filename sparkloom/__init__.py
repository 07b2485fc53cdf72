"""Spark-native analytics over source trees and text corpora."""
