"""corepick.sources"""
