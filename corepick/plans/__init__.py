"""corepick.plans"""
