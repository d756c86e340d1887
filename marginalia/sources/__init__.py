"""Where texts come from: directory trees and tables."""
