"""The query language: tokens, syntax trees and parsers for statements and migrations."""
