"""Query text, syntax trees and their compilation."""
